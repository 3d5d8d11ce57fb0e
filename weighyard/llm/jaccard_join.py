"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents become sets of five-word shingles; equal sets are one class. Two classes link when
100 * intersection >= 80 * union.

1. Shingles meet by hash range, in blocks that hold a shingle and a local class number in a few
   bytes; each shingle's frequency (classes that have it) comes from merging the blocks. Shingles
   of one class only can't link and are counted, not sent on.
2. A class orders its shingles by frequency. Two sets with intersection >= o share `l` shingles of
   their first (size - o + l), for every l up to o. A class whose rare shingles alone fill its
   prefix of l = 1 has no link. Every other class picks the `l` of the least estimated cost: the
   postings its prefix reads plus the candidates expected to share `l` of them, times what
   verifying one costs. A pair must share as many shingles as the smaller `l` of the two asks for.
3. First, in a few rounds, a class meets two leaders of its posting lists only; verified links give
   first components. What is left between components is shown exactly: classes outside the head of
   their family of posting lists meet its members in blocks that write links only (`families`), or,
   in families with very many of them, all pairs that share enough are joined and verified. So a
   group of near copies is not spelt out in pairs, while no link between two components is lost.

Rows of a pair carry the shared shingles of both classes for the verification. Components come
from `components`, where tasks join their own links first.

Cases: null text is the empty text; texts without words have an empty set and link with nothing;
with fewer than five words the whole sequence is the one shingle. Repeated rows and equal texts
fall into one class. Null ids are reported with a null component unless the class has another id.
An empty table gives an empty result. `keep_one` carries all columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighyard.llm.common import col, give_back, original, release, settle, sized, text_of, tidy
from weighyard.llm.components import task_components
from weighyard.llm.families import family_links, family_table
from weighyard.llm.shingles import set_key, shingle_set

#: Least share of the union, as a fraction of whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
#: Least number of hash ranges in which shingles meet; spark.sql.shuffle.partitions raises it, and so do
#: the texts: a range is meant to hold RANGE_SHINGLES.
RANGES = 64
RANGE_SHINGLES = 2_000_000
#: Characters per word, to tell the number of shingles from the length of the texts.
_WORD = 6
#: Shingles a task gathers before it sends blocks: 8 MB of hashes.
_GATHER = 1_000_000
_SETS = "doc_id long, key long, n_shingles long, class long"
LEVELS = 16


def document_sets(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """(doc_id, key of the text, n_shingles, class) of every row."""
    def sets(batches):
        for batch in batches:
            found = [shingle_set(body) for body in batch["body"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], batch["key"], pa.array([len(s) for s in found], pa.int64()),
                                   pa.array([set_key(s) if len(s) else None for s in found], pa.int64())],
                                  names=["doc_id", "key", "n_shingles", "class"])

    return docs.select(col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body")).withColumn(
        "key", F.xxhash64("body")).mapInArrow(tidy(sets), _SETS)


def shingle_blocks(docs: DataFrame, text="text") -> DataFrame:
    """(range, classes, sizes, hashes, owners): the shingles of a task's classes by hash range.

    `hashes` are sorted differences in as few bytes as they need; `owners` number the block's classes.
    A task holds one range at a time, so the number of ranges follows the length of all texts.
    """
    length = docs.select(F.sum(F.length(text_of(text)).cast("bigint"))).first()[0] or 0
    least = max(RANGES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), length // (_WORD * RANGE_SHINGLES))
    bits = (least - 1).bit_length()
    shift = 56 - bits

    def block(gathered):
        keys = np.array(list(gathered), np.int64)
        sizes = np.array([len(s) for s in gathered.values()], np.int64)
        hashes, owner = np.concatenate(list(gathered.values())), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        gathered.clear()
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        owner = owner[order]
        del order
        edges = np.append(np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(shift)), len(hashes))
        rows = [[], [], [], [], [], [], []]
        for at in range(1 << bits):
            a, b = edges[at], edges[at + 1]
            if a == b:
                continue
            used, local = np.unique(owner[a:b], return_inverse=True)
            steps = np.diff(hashes[a:b], prepend=np.uint64(0))
            steps[0] -= np.uint64(at << shift)
            width = max(1, (int(steps.max()).bit_length() + 7) // 8)
            packed = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
            wide = local.astype("<u2" if len(used) <= 65536 else "<u4")
            for column, value in zip(rows, (at, shift, keys[used].tobytes(), sizes[used].astype("<u4").tobytes(),
                                            packed, width, wide.tobytes()), strict=True):
                column.append(value)
        kinds = {"range": pa.int32(), "shift": pa.int32(), "classes": pa.binary(), "sizes": pa.binary(),
                 "hashes": pa.binary(), "width": pa.int32(), "owners": pa.binary()}
        return pa.record_batch([pa.array(column, kind) for column, kind in zip(rows, kinds.values(), strict=True)],
                               names=list(kinds))

    def blocks(batches):
        gathered, n = {}, 0
        for batch in batches:
            for body in batch["body"].to_pylist():
                found = shingle_set(body)
                key = set_key(found) if len(found) else None
                if key is None or key in gathered:
                    continue
                gathered[key] = found
                n += len(found)
                if n >= _GATHER:
                    yield block(gathered)
                    gathered, n = {}, 0
        if gathered:
            yield block(gathered)

    return docs.select(text_of(text).alias("body")).mapInArrow(
        tidy(blocks), "range int, shift int, classes binary, sizes binary, hashes binary, width int, owners binary")


def _unpacked(row) -> np.ndarray:
    """The sorted shingle hashes of one block row."""
    raw = np.frombuffer(row.hashes, np.uint8).reshape(-1, row.width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :row.width] = raw
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(int(row.range) << int(row.shift))


def _merge_range(frame: pd.DataFrame) -> pd.DataFrame:
    """(class, n, frequency, shingle): the shared shingles of one hash range.

    Most shingles occur once; classes and sizes are looked up for the others only.
    """
    parts = [_unpacked(row) for row in frame.itertuples(index=False)]
    starts = np.concatenate([[0], np.cumsum([len(part) for part in parts])])
    hashes = np.concatenate(parts)
    del parts
    order = np.argsort(hashes)
    hashes = hashes[order]
    again = hashes[1:] == hashes[:-1]
    met = np.zeros(len(hashes), bool)
    met[1:] = again
    met[:-1] |= again
    order, hashes = order[met], hashes[met]
    classes, sizes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    by = np.argsort(order)
    edges = np.searchsorted(order[by], starts)
    for at, row in enumerate(frame.itertuples(index=False)):
        mine = by[edges[at]:edges[at + 1]]
        keys = np.frombuffer(row.classes, "<i8")
        owners = np.frombuffer(row.owners, "<u2" if len(keys) <= 65536 else "<u4")[order[mine] - starts[at]]
        classes[mine] = keys[owners]
        sizes[mine] = np.frombuffer(row.sizes, "<u4")[owners]
    order = np.lexsort((classes, hashes))
    hashes, classes, sizes = hashes[order], classes[order], sizes[order]
    fresh = np.ones(len(hashes), bool)  # a class may come from several tasks
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (classes[1:] != classes[:-1])
    hashes, classes, sizes = hashes[fresh], classes[fresh], sizes[fresh]
    _, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    often = counts[at]
    shared = often > 1
    return pd.DataFrame({"class": classes[shared], "n": sizes[shared].astype(np.int32),
                         "frequency": often[shared].astype(np.int32), "shingle": hashes[shared].view(np.int64)})


def least_overlap(n):
    """Shingles that a set of n must share with any set it links with."""
    return -(-NUMERATOR * n // DENOMINATOR)


def choose_level(n: int, frequencies: np.ndarray, rare: int) -> int:
    """How many prefix shingles a pair must share: the cheapest by estimate.

    `frequencies` are those of the shared shingles in order, after `rare` shingles of the class alone.
    Reading a posting costs 1; a pair with l shared shingles is met at least l times, so at most
    (postings / l) candidates remain, each verified at the cost of n / 64.
    """
    base = n - least_overlap(n) - rare
    cumulated = np.concatenate([[0], np.cumsum(frequencies.astype(np.float64) - 1)])
    levels = np.arange(1, min(LEVELS, least_overlap(n)) + 1)
    reads = cumulated[np.clip(base + levels, 0, len(frequencies))]
    return int(levels[np.argmin(reads + reads / levels * (n / 64))])


def linkable_classes(blocks: DataFrame) -> DataFrame:
    """(class, n, level, base, shingles) of all classes that may have a link.

    `shingles` are those of two and more classes by frequency; `base` of them lie in the prefix
    before any level is added. A class gathers its own shingles only.
    """
    def levels(batches):
        for batch in batches:
            shared, sizes = batch["shared"], batch["n"].to_numpy()
            ends = shared.offsets.to_numpy() - shared.offsets[0].as_py()
            flat = shared.flatten()
            frequencies = flat.field("frequency").to_numpy()
            rare = sizes - np.diff(ends)
            level = [choose_level(int(n), frequencies[a:b], int(r)) for n, a, b, r in zip(sizes, ends[:-1], ends[1:], rare, strict=True)]
            base = [int(n) - least_overlap(int(n)) - int(r) for n, r in zip(sizes, rare, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["class"], batch["n"], pa.array(level, pa.int32()), pa.array(base, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.field("shingle"))],
                names=["class", "n", "level", "base", "shingles"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        give_back()  # what the range before held
        return _merge_range(frame)

    merged = blocks.groupBy("range").applyInPandas(merge, "class long, n int, frequency int, shingle long")
    own = merged.groupBy("class").agg(F.max("n").alias("n"), F.collect_list(F.struct("frequency", "shingle")).alias("shared"))
    return own.where(f"{DENOMINATOR}L * size(shared) >= {NUMERATOR}L * n").withColumn(
        "shared", F.array_sort("shared")).mapInArrow(
        tidy(levels), "class long, n int, level int, base int, shingles array<long>")


def postings(classes: DataFrame) -> DataFrame:
    """(shingle, class, n, level, needs, before, after): the prefix of every class.

    `needs` is the least level whose prefix has the shingle; `before` and `after` count the
    shared shingles on either side of it.
    """
    return classes.selectExpr(
        "class", "n", "level", "base", "size(shingles) AS m",
        "posexplode(slice(shingles, 1, base + level)) AS (before, shingle)").selectExpr(
        "shingle", "class", "n", "level", "greatest(1, before + 1 - base) AS needs", "before", "m - before - 1 AS after")


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard reaches the threshold."""
    side = lambda name: classes.select(
        F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col("shingles").alias(f"s_{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(
        f"{NUMERATOR + DENOMINATOR}L * size(array_intersect(s_a, s_b)) >= {NUMERATOR}L * (n_a + n_b)").select("a", "b")


#: Sizes and places of a common shingle that leave room for the overlap two sets need.
_FITS = (f"{DENOMINATOR}L * least(n, n_b) >= {NUMERATOR}L * greatest(n, n_b) AND {NUMERATOR + DENOMINATOR}L * "
         f"(least(before, before_b) + 1 + least(after, after_b)) >= {NUMERATOR}L * (n + n_b)")
#: Rounds in which a class meets one or two classes of its posting lists only.
LEADER_ROUNDS = 4


def crossing_lists(prefixes: DataFrame, found: DataFrame | None) -> DataFrame:
    """The postings of shingles that occur in more than one component, with their component."""
    placed = prefixes.withColumn("component", F.col("class")) if found is None else prefixes.join(
        found.select(F.col("node").alias("class"), "component"), "class", "left").withColumn(
        "component", F.coalesce("component", "class"))
    mixed = placed.groupBy("shingle").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    return placed.join(mixed, "shingle")


def leader_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """Each class with the two it meets most often among its lists' leaders, if of another component.

    A list's leaders are its first and last class in an order that changes from turn to turn.
    """
    drawn = F.xxhash64("class", F.lit(turn))
    leaders = lists.groupBy("shingle").agg(
        *[pick(column, drawn).alias(f"{name}_{column}") for name, pick in (("low", F.min_by), ("high", F.max_by))
          for column in ("class", "component")])
    met = lists.join(leaders, "shingle").selectExpr(
        "class", "component", "inline(array(struct(0 AS kind, low_class AS other, low_component AS theirs), "
        "struct(1 AS kind, high_class AS other, high_component AS theirs)))").where("component <> theirs")
    often = met.groupBy("class", "kind", "other").agg(F.count(F.lit(1)).alias("times"))
    return often.groupBy("class", "kind").agg(F.max_by("other", "times").alias("other")).select(
        F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


def crossing_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of different components that share as many prefix shingles as both ask for."""
    right = lists.select("shingle", *[F.col(name).alias("b" if name == "class" else f"{name}_b")
                                      for name in ("class", "n", "level", "needs", "before", "after", "component")])
    met = lists.withColumnRenamed("class", "a").join(right, "shingle").where(
        f"a < b AND component <> component_b AND {_FITS} AND greatest(needs, needs_b) <= least(level, level_b)")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max(F.least("level", "level_b")).alias("asked")).where(
        "shared >= asked").select("a", "b")


def class_components(docs: DataFrame, text="text") -> DataFrame:
    """(node, component) of all classes with a link."""
    classes = settle(linkable_classes(shingle_blocks(docs, text)))
    prefixes = settle(postings(classes))
    found = None
    for turn in range(LEADER_ROUNDS):
        near = settle(verified(leader_pairs(crossing_lists(prefixes, found), turn), classes))
        if near.isEmpty():
            break
        found = task_components(_stars(found, near))
        release(docs.sparkSession)
    lists = settle(crossing_lists(prefixes, found))
    families = family_table(lists, classes, task_components)
    release(docs.sparkSession)
    far = family_links(families, classes, NUMERATOR, DENOMINATOR)
    # Pairs inside a family whose queries fit are settled there; the others are joined list by list.
    large = families.where("NOT fits").select("class")
    if not large.isEmpty():
        far = far.union(verified(crossing_pairs(lists.join(large, "class", "left_semi")), classes))
    return task_components(_stars(found, far))


def _stars(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components so far as links to their smallest class, and new links."""
    return links if found is None else found.where("node <> component").select(
        F.col("node").alias("a"), F.col("component").alias("b")).union(links)


def linked(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """Per row: doc_id, key, n_shingles, class, component_id, and `ties`, the rows that carry component_id."""
    sets = settle(document_sets(docs, text, doc_id))
    by_class = sets.where("class IS NOT NULL").groupBy("class", "doc_id").agg(F.count(F.lit(1)).alias("rows")).groupBy(
        "class").agg(F.min("doc_id").alias("least"), F.coalesce(F.min_by("rows", "doc_id"), F.max("rows")).alias("rows"))
    placed = by_class.join(class_components(docs, text).withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class"))
    groups = placed.groupBy("component").agg(
        F.min("least").alias("component_id"), F.coalesce(F.min_by("rows", "least"), F.sum("rows")).alias("ties"))
    return sets.join(placed.select("class", "component").join(groups, "component"), "class", "left").select(
        "doc_id", "key", "n_shingles", "class",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "component", "ties")


def jaccard_components(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    return linked(docs, text, doc_id).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """Of each component the rows of its smallest id, one of them where it is repeated; all columns."""
    columns = docs.columns
    short = {name: f"c{at}" for at, name in enumerate(columns)}
    decided = settle(linked(docs, text, doc_id))
    dropped = settle(decided.where("class IS NOT NULL AND NOT doc_id <=> component_id").select("doc_id", "key").distinct())
    rows = docs.select(*[col(name).alias(alias) for name, alias in short.items()]).withColumn(
        "key", F.xxhash64(text_of(short[text]))).withColumn("doc_id", F.col(short[doc_id]).cast("long"))
    gone = sized(dropped, 24).select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    kept = rows.join(gone, F.col("key").eqNullSafe(F.col("gone_key")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    tied = settle(decided.where("ties > 1 AND doc_id <=> component_id").select("key", "component").distinct())
    if not tied.isEmpty():
        kept = kept.join(tied, "key", "left")
        kept = kept.where("component IS NULL").unionByName(
            kept.where("component IS NOT NULL").dropDuplicates(["component"]))
    return original(kept.select(*[F.col(alias).alias(name) for name, alias in short.items()]), columns)
