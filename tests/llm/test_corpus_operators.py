"""The corpus operators against brute force, held-out rows, exact round trips, and awkward input."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from weighyard.llm import (
    bpe_automaton,
    common,
    components,
    compression_quality,
    exact_dedup,
    hilbert_ann,
    jaccard_join,
    langid,
    licenses,
    packing,
    paragraph_dedup,
    pii,
    queries,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    common.ship_package(spark)

    def build(*texts, ids=None):
        ids = ids or range(1, len(texts) + 1)
        return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)], DOCS)
    return build


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r["doc_id"], r["text"] or "") for r in common.table(spark, SF, "documents").collect()]


def prose(seed, n):
    """Words that are all different from text to text."""
    random = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in random.integers(0, 26, 7)) for _ in range(n))


# --- personal data -----------------------------------------------------------------------------

def base_spans(text):
    def luhn(digits):
        doubled = [int(x) * 2 if at % 2 else int(x) for at, x in enumerate(reversed(digits))]
        return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0

    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255
                    or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            yield f"{kind}:{m.start()}:{m.end()}"


AWKWARD = [
    None, "", "a@b.cd%x@e.f and @ a@@b.c a@b", "1.2.3.4.5 999.1.1.1 0001.2.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (234) 567-8901 + 1 +1 2 3 +" + "9" * 30, "é😀 x@y.zz 4111111111111111é", "1" * 5000, "(" * 3000 + "+1", "a." * 4000,
    " ".join(f"u{n}@host{n}.org" for n in range(300)),
]


def test_pii_base_spans_are_those_of_the_plain_patterns(docs, corpus):
    texts = [*AWKWARD, *[t for _, t in corpus]]
    found = pii.find_personal_data(docs(*texts)).selectExpr("doc_id", f"{pii.spans_text('base')} AS base", "n_card")
    for row in found.collect():
        expected = list(base_spans(texts[row["doc_id"] - 1] or ""))
        assert row["base"] == ",".join(expected)
        assert row["n_card"] == sum(x.startswith("card") for x in expected)


def test_pii_adds_secrets_and_redacts(docs):
    key = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    frame = docs(f"x {key} y", "me@here.org and 10.1.2.3!", None, "plain words", "", "plain words")
    rows = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert rows == {1: 'x [SECRET]" y', 2: "[EMAIL] and [IP]!", 3: None, 4: "plain words", 5: "", 6: "plain words"}
    clash = frame.withColumnRenamed("lang", "body").withColumnRenamed("source", "spans").withColumnRenamed("n_chars", "base")
    assert pii.redact(clash).columns == clash.columns and pii.redact(frame.limit(0)).collect() == []


def test_pii_expectation_maximisation_finds_the_reliable_labeler():
    patterns = {(1, 1): 40.0, (-1, -1): 40.0, (1, 0): 10.0, (-1, 0): 10.0}
    prior, rates, chance = pii.expectation_maximisation(patterns, ["good", "shy"])
    assert 0.4 < prior < 0.6 and chance[(1, 1)] > 0.9 > 0.1 > chance[(-1, -1)]
    assert rates["good"][1][0] > rates["good"][1][1]


def test_pii_uses_no_python_on_the_executors(docs):
    plan = pii.find_personal_data(docs("a@b.cd"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- neighbours ----------------------------------------------------------------------------------

def brute_nearest(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows
              if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, v in usable:
        scores = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w in usable if j != i)
        yield i, scores[:k]


def test_neighbours_with_ties_copies_and_unusable_vectors(spark):
    common.ship_package(spark)
    random = np.random.default_rng(3)
    rows = [(n, random.normal(size=8).tolist()) for n in range(60)] + [(100 + n, [1.0] * 8) for n in range(20)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 204]
    found = hilbert_ann.nearest(frame, frame, k=5).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-round(r["score"], 12), r["vec_id"]))
    assert got == dict(brute_nearest(rows32, 5))
    assert hilbert_ann.nearest(frame.limit(0), frame.limit(0)).collect() == []


def test_neighbours_recall_with_narrow_windows(spark):
    frame = common.table(spark, SF, "embeddings").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    truth = dict(brute_nearest(rows, 5))
    found = hilbert_ann.nearest(frame, frame.where("vec_id % 50 = 0"), k=5, window=0.16, least=64).collect()
    hits = sum((r["vec_id"] in {j for _, j in truth[r["query_id"]]}) for r in found)
    assert hits >= 0.9 * 5 * len({r["query_id"] for r in found})


def test_hilbert_keys_visit_every_cell_once_and_step_by_one():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = hilbert_ann.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


# --- quality -------------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    rows = queries.op3_compression_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.9


def test_quality_without_labels_and_text(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = compression_quality.fit(docs("a"), none)
    frame = docs(None, "", "word " * 50000, "x", ids=[1, 1, None, 2])
    assert [r["score"] for r in compression_quality.score(frame, model).collect()] == [0.5] * 4


# --- near duplicates -------------------------------------------------------------------------------

def brute_components(rows):
    def shingles(text):
        words = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", words)
        if not words:
            return set()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common_size = len(sets[a] & sets[b])
            if common_size and 100 * common_size >= 80 * (len(sets[a]) + len(sets[b]) - common_size):
                parent[root(a)] = root(b)
    least = {}
    for at, (i, _) in enumerate(rows):
        least[root(at)] = min(least.get(root(at), i), i)
    return {i: (len(sets[at]), least[root(at)]) for at, (i, _) in enumerate(rows)}


def near_copies():
    """Chains and groups around the threshold, a line that all share, short and empty texts."""
    line, rows = prose(1, 12), []
    for group in range(4):
        words = prose(10 + group, 60).split()
        for copy in range(25):
            changed = list(words)
            for k in range(copy % 4):
                changed[(copy * 7 + k * 13) % 60] = prose(1000 * group + copy * 10 + k, 1)
            rows.append(" ".join(changed))
    rows += [f"{line} {prose(500 + n, 6)}" for n in range(30)]
    rows += [None, "", "  ", "a b", "A  b", "a b c d e", "a b c d e f", "w " * 50, "w " * 70, line, line]
    return list(enumerate(rows, 1))


def test_jaccard_components_by_brute_force(docs):
    rows = near_copies()
    frame = docs(*[t for _, t in rows])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame).collect()}
    assert found == brute_components(rows)
    kept = {r["doc_id"] for r in jaccard_join.keep_one(frame).collect()}
    assert kept == {i for i, (_, c) in found.items() if i == c}


def test_jaccard_pairs_of_families_that_do_not_fit(docs, monkeypatch):
    from weighyard.llm import families
    monkeypatch.setattr(families, "BLOCK_SHINGLES", 100)
    monkeypatch.setattr(jaccard_join, "LEADER_ROUNDS", 0)
    rows = near_copies()
    found = jaccard_join.jaccard_components(docs(*[t for _, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)


def test_jaccard_repeated_rows_null_ids_and_no_rows(docs):
    text = prose(2, 30)
    frame = docs(text, text, text + " more", None, "", ids=[7, 7, None, None, 3]).withColumnRenamed("lang", "class")
    kept = jaccard_join.keep_one(frame)
    assert Counter(r["text"] for r in kept.collect()) == {text: 1, None: 1, "": 1} and kept.columns == frame.columns
    assert jaccard_join.jaccard_components(frame.limit(0)).collect() == []


def test_jaccard_links_that_many_tasks_join(docs, monkeypatch):
    monkeypatch.setattr(components, "TASK_LINKS", 30)
    rows = near_copies()
    found = jaccard_join.jaccard_components(docs(*[t for _, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)


def test_jaccard_writes_few_tables_on_the_way(docs, monkeypatch):
    """Each one costs a shuffle's and a table's files, and a task's events, in every partition."""
    frame = docs(*[t for _, t in near_copies()])
    written, usual = [], type(frame).checkpoint
    monkeypatch.setattr(type(frame), "checkpoint", lambda self, *a, **b: written.append(1) or usual(self, *a, **b))
    assert jaccard_join.class_components(frame).count() > 20
    assert len(written) <= 17


def test_components_of_chains_stars_and_loops(spark):
    links = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 140)] + [(200, 200), (201, 202), (202, 201)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {
        **dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 201: 201, 202: 201}


# --- BPE -------------------------------------------------------------------------------------------

BYTE_BPE = f"{queries.TOKENIZERS}/byte_bpe_50k.json"


def test_bpe_ids_and_texts_are_those_of_the_library(docs, corpus, spark):
    texts = [None, "", " ", "a  b \n c", "don't  'LL", "<|endoftext|>x<|endoftext|>", "é😀 ", "a" * 3000, "՘'ll 1²",
             " \n\n x\t y ", *[t for _, t in corpus]]
    library = Tokenizer.from_file(BYTE_BPE)
    codec = bpe_automaton.Codec(spark, BYTE_BPE)
    encoded = codec.encode(docs(*texts)).select("doc_id", "ids")
    for row in encoded.collect():
        assert row["ids"] == library.encode(texts[row["doc_id"] - 1] or "", add_special_tokens=False).ids
    decoded = codec.decode(codec.encode(docs(*texts)))
    assert all(r["decoded"] == (r["text"] or "") for r in decoded.collect())
    assert codec.encode(docs("x").limit(0)).collect() == []


def test_bpe_decodes_missing_and_empty_lists(spark):
    codec = bpe_automaton.Codec(spark, f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    rows = spark.createDataFrame([(1, None), (2, []), (3, [40, 1]), (4, [160]), (5, [40])], "n int, ids array<int>").coalesce(1)
    library = Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    assert {r["n"]: r["decoded"] for r in codec.decode(rows).collect()} == {
        n: library.decode(ids, skip_special_tokens=False) for n, ids in [(1, []), (2, []), (3, [40, 1]), (4, [160]), (5, [40])]}
    assert codec.decode(rows.where("n < 3")).where("decoded = ''").count() == 2
    assert codec.decode(rows.where("n > 9")).count() == 0


def test_bpe_automaton_of_overlapping_merges():
    labels = {0: b"a", 1: b"b", 2: b"aa", 3: b"ab", 4: b"aab", 5: b"aaaa"}
    automaton = bpe_automaton.Automaton.compile(labels, [(0, 0, 2), (0, 1, 3), (2, 1, 4), (2, 2, 5)])

    def merged(word):
        ids = [0 if c == 97 else 1 for c in word]
        for u, v, w in [(0, 0, 2), (0, 1, 3), (2, 1, 4), (2, 2, 5)]:
            out, at = [], 0
            while at < len(ids):
                hit = ids[at:at + 2] == [u, v]
                out.append(w if hit else ids[at])
                at += 2 if hit else 1
            ids = out
        return ids

    for n in range(1, 10):
        for bits in range(1 << n):
            word = bytes(97 + (bits >> k & 1) for k in range(n))
            assert automaton.encode_word(word) == merged(word), word


# --- exact copies ----------------------------------------------------------------------------------

def test_copies_by_brute_force(docs):
    texts = ["x", "y", "x", None, "", "X", "x", "z " * 10000, "z " * 10000]
    ids = [5, 2, 9, 1, 4, 6, None, 8, 8]
    groups = {}
    for i, t in zip(ids, texts, strict=True):
        groups.setdefault(t or "", []).append(i)
    rows = exact_dedup.copies(docs(*texts, ids=ids)).collect()
    assert len(rows) == len(texts)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in rows:
        group = by_hash[r["text_sha256"]]
        keep = max(i for i in group if i is not None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(group), r["doc_id"] == keep)
    kept = exact_dedup.drop_copies(docs(*texts, ids=ids)).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 4, 6, 8, 9]
    assert exact_dedup.copies(docs("x").limit(0)).collect() == []


def test_quotient_filters_merge_without_loss():
    random = np.random.default_rng(5)
    values = random.integers(0, 1 << 63, 3000).astype(np.uint64)
    values = np.concatenate([values, values[:700], values[:50]])
    import pandas as pd
    names = ["segment", "quotients", "lengths", "remainders", "counts"]
    parts = [pd.DataFrame(list(exact_dedup.build_filters(p)), columns=names) for p in np.array_split(values, 7)]
    found = {}
    for _, group in pd.concat(parts).groupby("segment"):
        merged = exact_dedup._merge_segment(group[names])
        found |= dict(zip(merged["fingerprint"], merged["copies"], strict=True))
    truth = {int(np.uint64(v).view(np.int64)): n for v, n in Counter(values.tolist()).items() if n > 1}
    assert found == truth


# --- language --------------------------------------------------------------------------------------

def test_language_of_documents_and_pages(spark):
    rows = langid.identify_documents(common.table(spark, "/root/testdata/sf0.01", "documents")).collect()
    truth = {r["doc_id"]: r["lang"] for r in common.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert np.mean([r["lang"] == truth[r["doc_id"]] for r in rows]) > 0.98 and all(r["accepted"] for r in rows)
    pages = queries.page_languages(spark, SF).collect()
    assert np.mean([r["accepted"] for r in pages]) > 0.9


def test_language_rejects_what_no_language_explains(spark, docs):
    real = common.table(spark, SF, "documents")
    odd = docs(None, "", "123 456 !!", "ΩΨΞ ΔΘΛ ΠΣΦ " * 30, ids=[901, 902, None, 904])
    frame = real.unionByName(odd.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars"))
    kept = langid.keep_known(frame)
    assert kept.columns == real.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in real.collect()}
    assert langid.keep_known(real.limit(0)).collect() == []


# --- packing ---------------------------------------------------------------------------------------

def test_packing_whole_and_gapless(docs, corpus):
    vocabulary = f"{queries.TOKENIZERS}/word_bpe_49k.json"
    library = Tokenizer.from_file(vocabulary)
    texts = [None, "", "Don't STOP.", "<|endoftext|> a", "x\u0085y   z", "ÀÉ... ,.", "w " * 5000, *[t for _, t in corpus]]
    rows = packing.pack_documents(docs(*texts), vocabulary).collect()
    expected = {}
    for i, t in enumerate(texts, 1):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            expected[i, piece] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048
    assert len(ends) <= -(-sum(ends.values()) // 2048) + 2
    assert packing.pack_documents(docs("x").limit(0), vocabulary).collect() == []


@pytest.mark.parametrize("counts", [{}, {1: 5}, {10: 3, 5: 4, 2: 1}, {7: 10, 3: 10}, {6: 3, 2: 3, 1: 6}, {4: 9, 3: 8, 5: 2}])
def test_packing_plans_use_up_all_counts(counts):
    plan = packing.plan_patterns(counts, 10)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 10
        for length in pattern:
            used[length] += times
    assert used == Counter(counts)


# --- licences --------------------------------------------------------------------------------------

def test_license_rules(docs):
    mit = "\n".join(licenses.SENTENCES[name][0] for name in ("mit_grant", "mit_notice", "as_is_software", "no_liability"))
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", mit)
    texts = [None, "", "Words.\nReleased under the MIT License.\nMore.", mit, wrapped, "LICENSED UNDER CC BY-NC 4.0.!!",
             "The MIT in Boston.", mit + "\n" + "Licensed under the Apache License, Version 2.0.", licenses.SENTENCES["gpl_hope"][0]]
    rows = {r["doc_id"]: (r["licenses"], r["restricted"]) for r in licenses.licenses(docs(*texts)).collect()}
    assert rows == {1: ("", False), 2: ("", False), 3: ("MIT", False), 4: ("MIT", False), 5: ("MIT", False),
                    6: ("CC-BY-NC-4.0", True), 7: ("", False), 8: ("Apache-2.0,MIT", False), 9: ("unknown", True)}
    assert licenses.licenses(docs("x").limit(0)).collect() == []


# --- passages --------------------------------------------------------------------------------------

def test_passages_inside_other_texts(docs):
    passage = prose(77, 60)
    texts = [f"{prose(n, 40)} {passage} {prose(100 + n, 30)}" for n in range(6)] + [prose(200 + n, 120) for n in range(10)]
    texts += [None, "", "the " * 300, "few words here"]
    found = paragraph_dedup.repeated_passages(docs(*texts)).collect()
    assert {r["doc_id"] for r in found} == set(range(1, 7))
    assert all(40 - 12 <= r["start"] and r["end"] <= 100 + 12 for r in found)
    assert {r["doc_id"] for r in found if r["removed"]} == set(range(2, 7))
    cleaned = {r["doc_id"]: r["text"] for r in paragraph_dedup.drop_repeats(docs(*texts)).collect()}
    assert cleaned[1] == texts[0] and len(cleaned[2].split()) < len(texts[1].split()) and cleaned[7] == texts[6]
    assert paragraph_dedup.repeated_passages(docs("x").limit(0)).collect() == []


def test_passages_with_small_changes_are_verified_near_copies(docs, spark):
    words = prose(9, 60)
    found = paragraph_dedup.repeated_lines(docs(f"{words} tail", f"{words} other", prose(10, 60))).collect()
    assert {(r["doc_id"], r["removed"], r["keep_doc"]) for r in found} == {(1, False, 1), (2, True, 1)}


def test_registered_queries_and_pipeline(spark):
    import corpus_pipeline
    names = queries.queries()
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 11))
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in rows}
    source = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()]
    last = {}
    for i, t in source:
        last[t] = max(i, last.get(t, i))
    distinct = sorted((i, t) for t, i in last.items())
    parts = brute_components(distinct)
    assert ids == {i for i, (_, c) in parts.items() if i == c}
