"""Repeated passages against all pairs of lines, and what may leave a text."""

import random

import numpy as np
import pytest

from weighyard.llm import common
from weighyard.llm import paragraph_dedup as dedup
from weighyard.llm.shingles import shingle_set

TYPES = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    common.ship_package(spark)

    def build(*texts, ids=None):
        return spark.createDataFrame(list(zip(ids or range(1, len(texts) + 1), texts)), TYPES)
    return build


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


def changed(text, seed, times=1):
    rng, found = random.Random(seed), text.split()
    for at in rng.sample(range(len(found)), times):
        found[at] = f"changed{seed}x{at}"
    return " ".join(found)


def line_components(texts):
    """Components of long lines over documents by all pairs: {(doc, line): smallest (doc, line)}."""
    lines = [((d, k), shingle_set(line)) for d, text in enumerate(texts, 1)
             for k, line in enumerate(x for x in text.split("\n") if x.split()) if len(line.split()) >= dedup.LEAST_WORDS]
    root = {key: key for key, _ in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, s) in enumerate(lines):
        for b, t in lines[i + 1:]:
            common_ = len(np.intersect1d(s, t))
            if 5 * common_ >= 4 * (len(s) + len(t) - common_):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {key: find(key) for key, _ in lines}


def test_near_lines_by_all_pairs(docs):
    rng = random.Random(8)
    base = [prose(n, 120) for n in range(25)]
    texts = []
    for n in range(120):
        lines = [prose(1000 + 10 * n + k, rng.randint(3, 40)) for k in range(rng.randint(0, 3))]
        lines.insert(rng.randint(0, len(lines)), changed(base[n % 25], n, rng.randint(0, 3)))
        texts.append("\n".join(lines))
    wanted = line_components(texts)
    of = {}
    for key, top in wanted.items():
        of.setdefault(top, set()).add(key)
    groups = {frozenset(g) for g in of.values() if len({d for d, _ in g}) > 1}
    found = {}
    for r in dedup.repeated_lines(docs(*texts)).collect():
        found.setdefault(r.component, set()).add((r.doc_id, r.line))
    linked = sum(len(g) for g in groups)
    caught = sum(len(g) for g in groups if any(g <= frozenset(f) for f in found.values()))
    assert linked > 60 and caught >= 0.9 * linked
    # Nothing else is said to repeat.
    assert all(any(set(f) <= g for g in groups) for f in found.values())


def test_a_chain_of_middle_classes_keeps_its_links(docs):
    """Lines that are alike only step by step, many in one bucket."""
    text, texts = prose(5, 80).split(), []
    for n in range(30):
        texts.append(" ".join(text))
        text[(n * 7) % 80] = f"step{n}"
    found = {r.component for r in dedup.repeated_lines(docs(*texts)).collect()}
    assert len(found) == len(set(line_components(texts).values())) == 1


def test_changed_words_leave_a_passage_caught(docs):
    passage = prose(77, 60)
    texts = [passage, *[f"{prose(200 + n, 30)}\n{changed(passage, n)}\n{prose(300 + n, 25)}" for n in range(40)]]
    found = [r for r in dedup.repeated_lines(docs(*texts)).collect()]
    assert len({r.doc_id for r in found if r.removed}) >= 36
    assert all(r.keep_doc == 1 for r in found)


def test_passages_inside_lines(docs):
    passage = prose(78, 60)
    texts = [f"{prose(n, 40)} {passage} {prose(100 + n, 30)}" for n in range(6)] + [prose(200 + n, 120) for n in range(10)]
    found = dedup.repeated_passages(docs(*texts)).collect()
    assert {r.doc_id for r in found} == set(range(1, 7)) and {r.doc_id for r in found if r.removed} == set(range(2, 7))
    assert all(40 - 12 <= r.start and r.end <= 100 + 12 for r in found)


def test_no_piece_leaves_all_documents(docs):
    """Overlapping parts of one passage: each part's words stay somewhere (no near lines here)."""
    passage = prose(9, 160).split()
    texts = [" ".join(passage[:90]), " ".join(passage), " ".join(passage[60:])]
    after = {r.doc_id: r.text for r in dedup.drop_repeats(docs(*texts)).collect()}
    left = {w for text in after.values() for w in text.split()}
    assert left == set(passage)


@pytest.mark.parametrize("seed", range(2))
def test_random_mixtures_lose_no_piece(docs, seed):
    rng = random.Random(seed)
    pool = [prose(seed * 100 + n, rng.randint(10, 50)) for n in range(12)]
    texts = [rng.choice([" ", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(25)]
    after = [r.text for r in dedup.drop_repeats(docs(*texts)).collect()]
    words_before, words_after = {w for t in texts for w in t.split()}, {w for t in after for w in t.split()}
    assert words_before == words_after


def test_columns_nulls_repeated_ids_and_no_rows(spark, docs):
    passage = prose(3, 40)
    rows = [(1, passage, "x", 0.5, None), (2, passage + " end", "y", 1.5, "n"), (2, prose(4, 30), "z", 2.0, "n"),
            (None, passage, "w", 0.0, "n"), (3, None, "v", 0.0, "n"), (4, "", "u", 0.0, "n"), (1, passage, "x", 0.5, None),
            (5, "the " * 300, "t", 0.0, "n"), (6, "few words here", "s", 0.0, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, start double, `text key` string")
    found = dedup.drop_repeats(df)
    assert found.columns == df.columns
    out = sorted(map(tuple, found.collect()), key=str)
    kept = sorted(((r[0], r[1], *r[2:]) for r in rows if r[2] != "y"), key=str)
    assert [r for r in out if r[2] != "y"] == kept
    short, = [r[1] for r in out if r[2] == "y"]
    assert len(short.split()) < 15
    assert dedup.drop_repeats(df.limit(0)).collect() == [] and dedup.repeated_passages(df.limit(0)).collect() == []


def test_cuts_that_overlap():
    assert dedup.without("a b  c\nd e f", [(1, 3), (2, 4)]) == "a e f"
    assert dedup.without("a b c", [(0, 3)]) == "" and dedup.without("a b c", [(0, 1), (2, 3)]) == "b"
