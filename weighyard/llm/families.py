"""Exact links between small components and the rest of their family, without pair rows.

A family is a set of classes that share posting lists. In a family of near copies most classes
are in one component soon; what remains to be shown is, for each class outside it, whether any
member of another component links to it. Such classes are the family's queries. Members are
dealt over blocks of a bounded number of shingles, every block meets all queries of its family, and
only the first verified link from a query to a component is written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighyard.llm.common import settle
from weighyard.llm.components import components

#: Shingles of a block of members, and of all queries of a family that is handled this way.
BLOCK_SHINGLES = 4_000_000
_LINK = "a long, b long"
#: Shingles that a task gathers before it looks for links, and shared shingles that it holds at a time.
_GATHER, _HITS = 500_000, 2_000_000


def family_table(lists: DataFrame, classes: DataFrame, connect=components, least_block=BLOCK_SHINGLES) -> DataFrame:
    """(class, component, family, query, blocks, fits) of all classes in `lists` (shingle, class, component).

    `query` tells the classes outside the component with most shingles; `fits` the families whose
    queries are few enough. A block has as many shingles as the queries, `least_block` at least, so the
    copies of the queries weigh no more than the family. `connect` finds components.
    """
    ends = lists.groupBy("shingle").agg(F.min("class").alias("low"))
    joined = connect(lists.select("shingle", "class").join(ends, "shingle").select(
        F.col("class").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
    members = lists.select("class", "component").distinct().join(
        joined.select(F.col("node").alias("class"), F.col("component").alias("family")), "class").join(
        classes.select("class", F.size("shingles").alias("m")), "class")
    members = settle(members)
    weights = members.groupBy("family", "component").agg(F.sum("m").alias("w"))
    heads = weights.groupBy("family").agg(F.sum("w").alias("whole"), F.max("w").alias("most"),
                                          F.max_by("component", "w").alias("head"))
    return settle(members.join(heads, "family").select(
        "class", "component", "family", (F.col("component") != F.col("head")).alias("query"),
        F.ceil(F.col("whole") / F.greatest(F.lit(least_block), F.least(F.lit(BLOCK_SHINGLES), F.col("whole") - F.col("most")))).cast(
            "int").alias("blocks"),
        (F.col("whole") - F.col("most") <= BLOCK_SHINGLES).alias("fits")))


def _first_links(numerator: int, denominator: int):
    def run(key, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if members.empty or queries.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        sizes = np.array([len(x) for x in members["shingles"]])
        shingles = np.concatenate(members["shingles"].to_numpy())
        owner = np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(shingles, kind="stable")
        shingles, owner = shingles[order], owner[order]
        ids, parts, n = (members[name].to_numpy() for name in ("class", "component", "n"))
        out = []
        for query in queries.itertuples(index=False):
            own = np.asarray(query.shingles)
            low, high = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
            counts = high - low
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - low, counts)
            common = np.bincount(owner[at], minlength=len(members))
            near = (numerator + denominator) * common >= numerator * (n + query.n)
            near &= parts != query.component
            hits = np.nonzero(near)[0]
            if len(hits):
                _, first = np.unique(parts[hits], return_index=True)
                out += [(query[0], ids[hit]) for hit in hits[first]]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def family_links(families: DataFrame, classes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Verified links (a, b) between components of the families that fit."""
    whole = families.where("fits").join(classes.select("class", "n", "shingles"), "class")
    members = whole.select("class", "component", "n", "shingles", "family",
                           F.expr("CAST(pmod(xxhash64(class), blocks) AS INT)").alias("block"))
    queries = whole.where("query").select(
        "class", "component", "n", "shingles", "family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).toDF(
        "class", "component", "n", "shingles", "to_family", "to_block")
    return members.groupBy("family", "block").cogroup(queries.groupBy("to_family", "to_block")).applyInPandas(
        _first_links(numerator, denominator), _LINK)


def _shared(low: np.ndarray, high: np.ndarray, asking: np.ndarray, owner: np.ndarray, rows: int):
    """(asking row, member row, shared shingles) of all pairs, given each asking shingle's run in `owner`."""
    counts = high - low
    until = np.cumsum(counts)
    # Cuts between rows only, so that a pair is counted in one go.
    last = np.nonzero(np.append(asking[1:] != asking[:-1], True))[0] + 1
    at = 0
    while at < len(asking):
        fits = last[max(0, np.searchsorted(until[last - 1], (until[at - 1] if at else 0) + _HITS, "right") - 1):]
        end = next((int(x) for x in fits if x > at), len(asking))
        n, start = counts[at:end], low[at:end]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start, n)
        pair, common = np.unique(np.repeat(asking[at:end], n) * rows + owner[place], return_counts=True)
        yield pair // rows, pair % rows, common
        at = end


def block_links(rows: list[pa.RecordBatch], numerator: int, denominator: int) -> pa.RecordBatch:
    """First verified links from the rows that ask to each other component of their own family and block."""
    table = pa.Table.from_batches(rows).combine_chunks()
    ids, parts, n, asks, member = (table[name].to_numpy() for name in ("class", "component", "n", "asks", "member"))
    lists = table["shingles"].chunk(0)
    _, group = np.unique(np.stack([table["family"].to_numpy(), table["block"].to_numpy().astype(np.int64)]), axis=1, return_inverse=True)
    row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    _, number = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    key = number * (int(group.max()) + 1) + group[row]
    mine = member[row]
    owner, held = row[mine], key[mine]
    order = np.argsort(held, kind="stable")
    owner, held = owner[order], held[order]
    asking, wanted = row[asks[row]], key[asks[row]]
    _, part = np.unique(parts, return_inverse=True)
    found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b, common in _shared(np.searchsorted(held, wanted, "left"), np.searchsorted(held, wanted, "right"), asking, owner, len(ids)):
        near = ((numerator + denominator) * common >= numerator * (n[a].astype(np.int64) + n[b])) & (parts[a] != parts[b])
        a, b = a[near], b[near]
        _, first = np.unique(a * len(ids) + part[b], return_index=True)
        found[0].append(ids[a[first]])
        found[1].append(ids[b[first]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["a", "b"])


def packed_links(families: DataFrame, classes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """`family_links` where most families are small: a task settles many of its blocks at once.

    A class is one row of its own block; one that asks has a row in each other block of its family, too.
    """
    def run(batches):
        gathered, n, last = [], 0, None
        for batch in batches:
            keys = list(zip(batch["family"].to_pylist(), batch["block"].to_pylist(), strict=True))
            sizes = batch["n"].to_numpy()
            start = 0
            for at, key in enumerate(keys):
                if key != last and n >= _GATHER:
                    if at > start:
                        gathered.append(batch.slice(start, at - start))
                    yield block_links(gathered, numerator, denominator)
                    gathered, n, start = [], 0, at
                n, last = n + int(sizes[at]), key
            gathered.append(batch.slice(start))
        if n:
            yield block_links(gathered, numerator, denominator)

    whole = families.where("fits").join(classes.select("class", "n", "shingles"), "class").withColumn(
        "own", F.expr("CAST(pmod(xxhash64(class), blocks) AS INT)"))
    rows = whole.withColumn("block", F.explode(F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array("own")))).select("family", "block", "class", "component", "n", F.col("query").alias("asks"),
                                 (F.col("block") == F.col("own")).alias("member"), "shingles")
    return rows.repartition("family", "block").sortWithinPartitions("family", "block").mapInArrow(run, _LINK)
