"""Language-model scores: counts against a plain program, normalisation, and a gain on held-out texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from weighyard.llm import lm_scoring as lm

TYPES = "doc_id long, text string"


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def plain_base(train, texts):
    counts = Counter(t for text in train for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    return [(len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), total,
             sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens(x))) for x in texts]


def same_base(found, wanted):
    for row, (n, known, total, base) in zip(found, wanted, strict=True):
        assert (row.n_tokens, row.n_known, row.train_tokens) == (n, known, total)
        assert row.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert math.isfinite(row.score) and row.score < 0


def test_given_documents_beat_the_unigram_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr(
        "doc_id", "text", "coalesce(crc32(CAST(doc_id AS STRING)) % 5 = 1, false) AS held_out")
    rows = docs.orderBy("doc_id").collect()
    found = lm.score(docs, lm.train(docs.where("NOT held_out")), carry=["doc_id", "held_out"]).orderBy("doc_id").collect()
    same_base(found, plain_base([r.text for r in rows if not r.held_out], [r.text for r in rows]))
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.98


def test_rare_words_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 6)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["The", "of", "tab\tx", "rare%d" % rng.randint(0, 40)]) for _ in range(30)) for _ in range(40)]
    train, test = texts[:30], [*texts, "never seen words", "", None, "Ünï Ü x", "THE the The"]
    made = lm.train(spark.createDataFrame(list(enumerate(train)), TYPES), shortlist=3, spellings=2)
    found = lm.score(spark.createDataFrame(list(enumerate(test)), TYPES).repartition(3), made).orderBy("doc_id").collect()
    same_base(found, plain_base(train, test))


def test_probabilities_of_the_next_token_add_to_one(spark):
    rng = random.Random(2)
    train = [" ".join(rng.choice("abcdefghij") for _ in range(20)) for _ in range(30)]
    made = lm.train(spark.createDataFrame(list(enumerate(train)), TYPES), shortlist=5, spellings=3)
    classes, model = made.classes, made.model
    k = classes.count
    by_one, by_two, norms = model.tables()
    for two, one in [(0, 1), (k, k)]:
        plain = (model.predicted(np.array([two]), np.array([one])) @ model.q.T + model.b)[0]
        np.testing.assert_allclose(plain, by_one[one] + by_two[two])
        assert np.exp(plain - norms[two, one]).sum() == pytest.approx(1)
    # Within a class: known words by their counts, and half a count for an unknown one in a spelled class.
    within = Counter()
    for word, place in classes.head.items():
        within[int(classes.of_head[place])] += classes.counts[place] + 0.5
    for c in range(k):
        assert within[c] + (0.5 if c >= classes.shortlist else 0) == pytest.approx(math.exp(made.masses[c]))


def test_order_of_words_counts(spark):
    train = ["a b c d"] * 400 + ["d c a"] * 20
    made = lm.train(spark.createDataFrame(list(enumerate(train)), TYPES), spellings=2, epochs=60)
    found = lm.score(spark.createDataFrame([(1, "a b c d"), (2, "b a d c")], TYPES), made).orderBy("doc_id").collect()
    assert found[0].score > found[1].score + 1
    assert found[0].base_score == pytest.approx(found[1].base_score)


def test_no_training_texts_and_empty_tables(spark):
    none = spark.createDataFrame([], TYPES)
    made = lm.train(none)
    found = lm.score(spark.createDataFrame([(1, "some words"), (None, None)], TYPES), made).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found] == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert lm.score(none, made).collect() == []


def test_repeated_rows_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{n % 50}" for n in range(600_000)) + "\n" + "x" * 500
    assert len(long) > 2 * lm.PIECE
    rows = [(1, long, 5.0, "r", 1), (1, long, 5.0, "r", 1), (2, "w1 w2", 6.0, "s", 2)]
    df = spark.createDataFrame(rows, TYPES + ", score double, row string, `c 0` int")
    found = lm.score(df, lm.train(df)).orderBy("doc_id").collect()
    assert [r["row"] for r in found] == ["r", "r", "s"] and [r["c 0"] for r in found] == [1, 1, 2]
    assert found[0] == found[1]
    same_base(found, plain_base([r[1] for r in rows], [r[1] for r in rows]))


def test_pieces_keep_whole_words():
    for size in (1, 3, 7, 1000):
        text = b"Alpha beta\x0bgamma  delta\x1fepsilon " * 5
        lm_piece, lm.PIECE = lm.PIECE, size
        try:
            assert [w for part in lm.token_lists(text) for w in part] == text.lower().split() + [b""]
        finally:
            lm.PIECE = lm_piece
