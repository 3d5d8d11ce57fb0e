"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are brought to length 1 and projected by random directions onto a few dimensions, once per
curve. The projection, moved by a random shift, becomes a cell of a grid; the Hilbert key of the
cell orders all vectors along the curve. Rows are range-partitioned by (curve, key), numbered along
each curve and cut into blocks. A query is sent to the blocks around its own, so many on either
side that they hold `window` of the rows; there it meets all rows in one matrix product in double
precision. The best of all blocks and curves merge into the answer.

The nearness of everything met is exact, so only rows that no window shows can be missed. Many
narrow windows find more than few wide ones for the same number of rows met. Vectors without
structure (nearly orthogonal to each other, as in the test tables) still need a share of the rows
per curve; clustered vectors may take a smaller `window`. Queries that meet the same block are
split into parts of at most `QUERIES`, so no task's matrix grows with the table.

Equal vectors are one point of the curves with the smallest ids they need (k + 1), so a vector that
a third of all rows share is one row, and ties go to the smaller id.

Cases: vectors that are null, zero, of another length than most, or with null or non-finite components
take no part. Fewer than k candidates give fewer rows. Null ids take no part. A row repeated with its
id and vector is one candidate. Equal ids with different vectors are different candidates, and as
queries each vector gets an answer of its own; no row of the query's id is in it. An empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weighyard.llm.common import col, settle

CURVES = 24
DIMENSIONS = 6
BITS = 8
#: Share of the rows that a query meets along each curve, and rows at least per neighbour asked for.
WINDOW, LEAST_ROWS = 0.035, 4
#: Rows of a block along a curve, at most, and queries that a task meets with it at a time.
BLOCK, QUERIES = 1024, 8192


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve positions of integer cells [rows, dimensions], by the transpose method."""
    x = cells.astype(np.uint64).copy()
    dimensions = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(dimensions):
            high = (x[:, i] & np.uint64(q)) != 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dimensions):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[:, dimensions - 1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    x ^= turn[:, None]
    keys = np.zeros(len(x), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dimensions):
            keys = (keys << np.uint64(1)) | ((x[:, i] >> np.uint64(bit)) & np.uint64(1))
    return keys


def curve_keys(unit: np.ndarray, curve: int, dimensions=DIMENSIONS, bits=BITS) -> np.ndarray:
    """Keys of unit vectors on one curve; projection and shift follow from its number."""
    random = np.random.default_rng(1000 + curve)
    directions = np.linalg.qr(random.normal(size=(unit.shape[1], min(dimensions, unit.shape[1]))))[0]
    # A projection of a unit vector is about 1 / sqrt(length) wide; twice that to either side fills the grid.
    scaled = unit @ directions * math.sqrt(unit.shape[1]) / 4.0 + 0.25 + random.uniform(0, 0.5, directions.shape[1])
    return hilbert_keys(np.clip(scaled * (1 << bits), 0, (1 << bits) - 1), bits)


def usable(vectors: DataFrame, vec_id="vec_id", embedding="embedding") -> DataFrame:
    """(id, vector, point): the rows that take part, each once; `point` is the hash of the vector."""
    rows = vectors.select(col(vec_id).cast("long").alias("id"), col(embedding).cast("array<double>").alias("vector")).where(
        """id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL
        OR isnan(x) OR abs(x) = double('Infinity')) AND exists(vector, x -> x <> 0)""")
    # -0 and 0 are the same number
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if lengths:
        rows = rows.where(F.size("vector") == lengths[0]["n"])
    return rows.withColumn("point", F.xxhash64("vector")).dropDuplicates(["id", "point"])


def points(rows: DataFrame, k: int) -> DataFrame:
    """(point, vector, ids): distinct vectors with their k + 1 smallest ids."""
    first = Window.partitionBy("vector").orderBy("id")
    return rows.withColumn("row", F.row_number().over(first)).where(F.col("row") <= k + 1).groupBy("point", "vector").agg(
        F.array_sort(F.collect_list("id")).alias("ids"))


def on_curves(rows: DataFrame, curves: int) -> DataFrame:
    """(curve, key, point) for every curve; vectors stay behind."""
    def run(batches):
        for batch in batches:
            vectors = np.array(batch["vector"].to_pylist(), np.float64)
            if not len(vectors):
                continue
            unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
            for curve in range(curves):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(unit), curve, np.int32)), pa.array(curve_keys(unit, curve).view(np.int64)),
                     batch["point"]], names=["curve", "key", "point"])

    return rows.select("point", "vector").mapInArrow(run, "curve int, key long, point long")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their place along their curve, by range partitions and running totals."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = settle(rows.repartitionByRange(parts, "curve", "key", "point").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", "curve").orderBy("key", "point")
    earlier = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("part", "curve").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return ordered.withColumn("row", F.row_number().over(inside)).join(totals, ["part", "curve"]).withColumn(
        "place", F.col("earlier") + F.col("row") - 1).drop("part", "row", "earlier")


_FOUND = {"query_id": "int64", "query_point": "int64", "vec_id": "int64", "point": "int64", "score": "float64"}


def _meet(k: int):
    """For one block of a curve: the k best rows of each query sent to it."""
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            left = np.stack(queries["vector"].to_numpy()).astype(np.float64)
            right = np.stack(rows["vector"].to_numpy()).astype(np.float64)
            left /= np.linalg.norm(left, axis=1)[:, None]
            right /= np.linalg.norm(right, axis=1)[:, None]
            best = min(k + 1, len(rows))  # one may be the query's own point
            ids, of = rows["ids"].to_numpy(), rows["point"].to_numpy()
            asked = queries[["query_id", "query_point"]].to_numpy()
            for start in range(0, len(left), BLOCK):
                scores = left[start:start + BLOCK] @ right.T
                cuts = np.partition(scores, len(rows) - best, axis=1)[:, len(rows) - best]
                for at, found in zip(*np.nonzero(scores >= cuts[:, None]), strict=True):
                    query, own = asked[start + at]
                    out += [(query, own, i, of[found], scores[at, found]) for i in ids[found] if i != query]
        return pd.DataFrame(out, columns=list(_FOUND)).astype(_FOUND)

    return run


def exact_scores(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The candidates with their cosine from the original vectors, summed in the order of the components."""
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    return found.join(rows.toDF("query_id", "q", "query_point"), ["query_id", "query_point"]).join(
        rows.toDF("vec_id", "c", "point"), ["vec_id", "point"]).withColumn(
        "score", F.expr(f"{dot('q', 'c')} / (sqrt({dot('q', 'q')}) * sqrt({dot('c', 'c')}))")).drop("q", "c")


def nearest(vectors: DataFrame, queries: DataFrame, k=5, curves=CURVES, window=WINDOW, least=None,
            vec_id="vec_id", embedding="embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, itself left out.

    `queries` has the columns of `vectors` and is part of it. A window holds `window` of the points,
    `least` (by default LEAST_ROWS per neighbour) at least.
    """
    own = settle(usable(vectors, vec_id, embedding)).select("id", "vector", "point")
    settled = settle(points(own, k))
    total = settled.count()
    placed = settle(numbered(on_curves(settled, curves)).select("curve", "place", "point"))
    # Orders and places travel without vectors, which join their blocks in the precision they came in.
    kind = vectors.select(col(embedding)).schema[0].dataType.simpleString()
    narrow = F.col("vector").cast("array<float>" if kind == "array<float>" else "array<double>")
    held = settled.select("point", "ids", narrow.alias("vector"))
    span = max(LEAST_ROWS * (k + 1) if least is None else least, math.ceil(window * total))
    block = min(BLOCK, math.ceil(span / 6))
    reach = math.ceil(span / 2 / block)
    last = max(0, (total - 1) // block)
    asked = queries.select(col(vec_id).cast("long").alias("id"), F.transform(
        col(embedding).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector")).select(
        F.col("id").alias("query_id"), F.xxhash64("vector").alias("point")).distinct()
    at = settle(placed.join(asked, "point"))
    # As many parts of each block as its queries need; a query goes to one of them.
    most = at.groupBy("curve", F.expr(f"place DIV {block}").alias("block")).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, math.ceil(most * (2 * reach + 1) / QUERIES))
    rows = placed.join(held, "point").selectExpr("curve", f"CAST(place DIV {block} AS INT) AS block", "ids", "point", "vector",
                             f"explode(sequence(0, {parts - 1})) AS part")
    # At an end of the curve the window moves inwards instead of getting shorter.
    sent = at.join(held.drop("ids"), "point").selectExpr("query_id", "point AS query_point", "vector", "curve AS to_curve", f"""explode(sequence(
        greatest(0, least(CAST(place DIV {block} AS INT), {last} - {reach}) - {reach}),
        least({last}, greatest(CAST(place DIV {block} AS INT), {reach}) + {reach}))) AS to_block""",
                         f"CAST(pmod(xxhash64(query_id, point), {parts}) AS INT) AS to_part")
    sent = sent.toDF(*sent.columns)  # columns of its own, apart from those of the rows
    schema = "query_id long, query_point long, vec_id long, point long, score double"
    found = rows.groupBy("curve", "block", "part").cogroup(sent.groupBy("to_curve", "to_block", "to_part")).applyInPandas(
        _meet(k), schema)
    best = found.groupBy("query_id", "query_point", "vec_id", "point").agg(F.max("score").alias("score"))
    # Scores of two sums may differ in their last digits: keep what may still be among the k, then score exactly.
    nearly = Window.partitionBy("query_id", "query_point").orderBy(F.desc("score"), "vec_id")
    kept = best.withColumn("row", F.row_number().over(nearly)).where(F.col("row") <= 2 * k + 1).drop("row", "score")
    final = Window.partitionBy("query_id", "query_point").orderBy(F.desc("score"), "vec_id")
    return exact_scores(kept, own).withColumn("rank", F.row_number().over(final)).where(
        F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
