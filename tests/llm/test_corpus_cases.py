"""Cases of the corpus operators: repeated rows, clashing names, hidden columns, merged filters."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weighyard.llm import bpe_automaton, common, compression_quality, exact_dedup, hilbert_ann, langid, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def shipped(spark):
    common.ship_package(spark)


# --- neighbours ----------------------------------------------------------------------------------

def answers(frame, wanted, **options):
    found = {}
    for r in sorted(hilbert_ann.nearest(frame, wanted, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 12)))
    return found


def plain(rows, wanted, k):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows}
    for i in wanted:
        best = sorted((-round(float(unit[i] @ unit[j]), 12), j) for j in unit if j != i)[:k]
        yield i, [(at + 1, j, -score) for at, (score, j) in enumerate(best)]


def test_neighbours_of_rows_that_are_repeated(spark):
    random = np.random.default_rng(11)
    rows = [(n, random.normal(size=6).tolist()) for n in range(40)]
    truth = dict(plain(rows, range(40), 5))
    nothing = [float("nan")] * 6
    again = rows + [rows[1], rows[5], rows[5], (5, nothing), (7, None), (9, [0.0] * 6)]
    frame = spark.createDataFrame(again, "vec_id long, embedding array<double>")
    assert answers(frame, frame) == truth


def test_neighbours_of_an_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = hilbert_ann.nearest(frame, frame.where("vec_id = 1"), k=1).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(1, 1, 2), (1, 1, 3)]
    found = hilbert_ann.nearest(frame, frame.where("vec_id = 2"), k=5).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1), (2, 3), (3, 1)]


def test_neighbours_when_queries_of_a_block_are_split(spark, monkeypatch):
    frame = common.table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id", "embedding")
    wanted = frame.where("vec_id % 10 = 0")
    whole = answers(frame, wanted)
    monkeypatch.setattr(hilbert_ann, "QUERIES", 8)
    assert answers(frame, wanted) == whole


def test_neighbours_recall_of_the_registered_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in common.table(spark, SF, "embeddings").collect()]
    truth = dict(plain(rows, [i for i, _ in rows if i % 50 == 0], 5))
    found = queries.op2_hilbert_ann(spark, SF).collect()
    assert len(found) == 5 * len(truth)
    hits = sum(r["vec_id"] in {j for _, j, _ in truth[r["query_id"]]} for r in found)
    assert hits >= 0.9 * len(found)


# --- quality -------------------------------------------------------------------------------------

def test_quality_replaces_a_column_of_the_same_name(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text").selectExpr("doc_id", "text", "'old' AS score", "1 AS `a b.c`")
    model = compression_quality.fit(docs, common.table(spark, SF, "labels"))
    scored = compression_quality.score(docs, model)
    assert scored.columns == ["doc_id", "text", "a b.c", "score"]
    assert all(0 <= r["score"] <= 1 for r in scored.collect())


def test_quality_windows_cover_whole_texts():
    assert compression_quality.even_share([10, 100, 100], 110) == 50
    assert compression_quality.even_share([10, 20], 100) >= 20
    raw = bytes(range(256)) * 100
    part = compression_quality.spread(raw, 2000)
    assert 1900 <= len(part) <= 2000 and compression_quality.spread(raw, 1 << 20) == raw
    halves = compression_quality.spread(b"a" * 20000 + b"b" * 20000, 2000)
    assert abs(halves.count(b"a") - halves.count(b"b")) <= compression_quality.WINDOW


def test_quality_fits_on_repeated_ids_and_long_texts(spark):
    random = np.random.default_rng(4)
    words = [["%s%d" % (c, n) for n in range(200)] for c in ("zq%x", "word")]
    rows = [(n % 12, " ".join(random.choice(words[n % 2], 6000 if n < 2 else 120))) for n in range(48)]
    docs = spark.createDataFrame(rows + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(12)] + [(1, 1, 0), (99, 0, 0), (None, 1, 0), (2, None, 0)],
                                   "doc_id long, quality int, toxic int")
    scored = compression_quality.score(docs, compression_quality.fit(docs, labels)).collect()
    assert len(scored) == 50
    by_side = {side: [r["score"] for r in scored if r["doc_id"] is not None and r["text"] and r["doc_id"] % 2 == side] for side in (0, 1)}
    assert min(by_side[1]) > max(by_side[0])


# --- token automaton -----------------------------------------------------------------------------

def test_bpe_replaces_columns_of_the_same_name(spark):
    path = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
    codec = bpe_automaton.Codec(spark, path)
    docs = spark.createDataFrame([(1, "some words", "x", 2)], "`doc id` int, text string, decoded string, ids int")
    encoded = codec.encode(docs)
    assert encoded.columns == ["doc id", "text", "decoded", "ids"]
    assert encoded.first()["ids"] == Tokenizer.from_file(path).encode("some words", add_special_tokens=False).ids
    decoded = codec.decode(encoded)
    assert decoded.columns == ["doc id", "text", "decoded"] and decoded.first()["decoded"] == "some words"


# --- exact copies --------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40).map(lambda x: x * 0x9E3779B97F4A7C1 % (1 << 64)), max_size=30), max_size=6))
def test_sorted_sequences_merge_without_loss(parts):
    values, counts = exact_dedup.merged_all([exact_dedup.counted(np.array(p, np.uint64)) for p in parts])
    truth = Counter(x for p in parts for x in p)
    assert values.tolist() == sorted(truth) and dict(zip(values.tolist(), counts.tolist(), strict=True)) == truth


@pytest.mark.parametrize("bits", [10, 13, 20])
def test_filters_hold_what_they_were_given(bits):
    values, counts = exact_dedup.counted(np.random.default_rng(2).integers(0, 1 << 64, 5000, dtype=np.uint64))
    parts = [exact_dedup.read_filter(*f, bits=bits) for f in exact_dedup.build_filters(values, counts, bits)]
    found = exact_dedup.merged_all(parts)
    assert (found[0] == values).all() and (found[1] == counts).all()


def test_segments_follow_the_number_of_rows():
    assert exact_dedup.segment_bits(0) == exact_dedup.segment_bits(1 << 32) == exact_dedup.SEGMENT_BITS
    assert exact_dedup.segment_bits(1 << 36) == 14


def test_copies_are_folded_before_the_shuffle(spark):
    docs = common.table(spark, SF, "documents")
    plan = exact_dedup.copy_groups(docs)._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.rindex("hashpartitioning(fingerprint"):] if "hashpartitioning(fingerprint" in plan else ""
    assert "partial_count(1)" in before and "partial_max" in before


def test_rows_without_ids_and_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (4, "b"), (4, "b"), (3, "b"), (5, "c")], "doc_id long, text string")
    kept = exact_dedup.drop_copies(docs).collect()
    assert sorted((r["text"], r["doc_id"] or 0) for r in kept) == [("a", 0), ("b", 4), ("c", 5)]


# --- language ------------------------------------------------------------------------------------

def test_language_without_any_declaration(spark):
    docs = common.table(spark, SF, "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    hidden = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    rows = langid.identify_documents(hidden).collect()
    assert np.mean([r["lang"] == truth[r["doc_id"]] for r in rows]) > 0.95
    assert np.mean([r["accepted"] for r in rows]) > 0.99


def test_function_words_name_a_language():
    vote = langid.function_word_vote
    assert vote("The house of the king is by the sea.") == "en"
    assert vote("Der Hund und die Katze sind nicht mit dem Kind.") == "de"
    assert vote("El perro y los gatos están muy bien hasta hoy") == "es"
    assert vote("Le chien et les chats sont dans la maison") == "fr"
    assert vote("") is None and vote("the der el le") is None and vote("123 456") is None
    words = [w for text in langid.FUNCTION_WORDS.values() for w in text.split()]
    assert len(words) == len(set(words))


def test_language_carries_columns_with_any_name(spark):
    rows = [(1, "the house of the king is by the sea", "en", "", "", "h", "old", 1.0, "kept")]
    frame = spark.createDataFrame(rows, "id int, body string, declared string, suffix string, domain string, host string, "
                                        "lang string, fit double, `a b.c` string")
    found = langid.identify(frame)
    assert found.columns == ["id", "fit", "a b.c", *langid.RESULTS]
    row = found.first()
    assert (row["id"], row["fit"], row["a b.c"], row["lang"]) == (1, 1.0, "kept", "en")
