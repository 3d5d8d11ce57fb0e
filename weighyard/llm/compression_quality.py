"""Quality by compression.

Two zstandard dictionaries hold labelled text, one good, one bad. A text that looks like good text
compresses better with the first, so the difference of the two sizes, divided by the text's
size, tells them apart. Texts are compressed in pieces, each afresh with the dictionary, so that a
long text does not become its own dictionary; all pieces of a text count. A logistic curve, fitted
on labelled rows whose text is in no dictionary, turns difference and compressibility into a
probability.

Dictionaries and curve come from a bounded sample of labelled rows: at most `SAMPLE_ROWS` per
label, those with the smallest hash of their id. One half gives the dictionaries, each of its texts as
much as any other: windows of `WINDOW` bytes spread evenly over the whole text until the dictionary holds
`DICTIONARY_BYTES`, shorter texts whole. The other half, read whole, gives the curve. Scoring
reads every text whole, and nothing but the text.

Cases: null text is the empty text; empty texts get the share of good rows as their score. Labels that
are null, repeated or of no document are left out; an id with both labels counts for both, and one with
several texts gives the first of them. Without labels of both sorts every score is 0.5. Null ids and
repeated rows are carried, and a column named like the score is replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighyard.llm.common import col, plain_names, settle, text_of

SAMPLE_ROWS = 1200
DICTIONARY_BYTES = 256 << 10
WINDOW = 400
PIECE = 2048
LEVEL = 1
THRESHOLD = 0.3


class Sizer:
    """Bytes that a text takes with either dictionary."""

    def __init__(self, dictionaries: list[bytes]):
        kind = zstandard.DICT_TYPE_RAWCONTENT
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.compressors = []
        for content in dictionaries:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=kind)
            dictionary.precompute_compress(compression_params=parameters)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters))

    def features(self, text: str) -> tuple[float, float]:
        """(size with good minus size with bad, smaller size), both per byte of the text."""
        raw = text.encode("utf-8", "replace")
        if not raw:
            return 0.0, 1.0
        good, bad = (sum(len(c.compress(raw[at:at + PIECE])) for at in range(0, len(raw), PIECE))
                     for c in self.compressors)
        return (good - bad) / len(raw), min(good, bad) / len(raw)


@dataclass
class QualityModel:
    dictionaries: list[bytes]
    weights: list[float]
    means: list[float]
    scales: list[float]
    prior: float


def logistic(x: np.ndarray, y: np.ndarray, rounds=60) -> np.ndarray:
    """Weights by iterated least squares with a small ridge; the first is the bias."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-1] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def even_share(sizes: list[int], budget: int) -> int:
    """The most bytes that every text may give so that all stay within the budget; shorter ones give all they have."""
    left, share = budget, 0
    for at, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - at)
        if size > share:
            break
        left -= size
    return share


def spread(raw: bytes, share: int) -> bytes:
    """`share` bytes of a text in windows spread evenly over all of it."""
    if len(raw) <= share:
        return raw
    windows = max(1, round(share / WINDOW))
    width = share // windows
    starts = [int((at + 0.5) * len(raw) / windows - width / 2) for at in range(windows)]
    return b"".join(raw[start:start + width] for start in starts)


def fit(docs: DataFrame, labels: DataFrame, text="text", doc_id="doc_id") -> QualityModel:
    """A model from labels (doc_id, quality); quality 1 is good, 0 is bad."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where(
        "id IS NOT NULL AND quality IN (0, 1)").distinct()
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    chosen = None
    for quality in (0, 1):
        part = known.where(F.col("quality") == quality).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * SAMPLE_ROWS texts; they stay in Spark, the driver gets sizes, windows and features.
    sample = settle(docs.select(col(doc_id).cast("long").alias("id"), text_of(text).alias("body")).where("body <> ''").join(
        F.broadcast(chosen), "id").groupBy("id", "quality").agg(F.min("body").alias("body")))
    sizes = {(r["quality"], r["id"]): r["n"] for r in sample.select("quality", "id", F.octet_length("body").alias("n")).collect()}
    sides = [sorted(key for key in sizes if key[0] == quality) for quality in (1, 0)]
    if not all(len(side) >= 4 for side in sides):
        return QualityModel([b" ", b" "], [0.0, 0.0, 0.0], [0.0, 0.0], [1.0, 1.0], 0.5)
    mixed = [[side[at] for at in np.random.default_rng(7).permutation(len(side))] for side in sides]
    named = [side[:len(side) // 2] for side in mixed]
    # The same budget for both: the larger dictionary must not win by its size.
    budget = min(DICTIONARY_BYTES, *[sum(sizes[key] for key in side) for side in named])
    shares = [even_share([sizes[key] for key in side], budget) for side in named]
    place = {key: (side, at) for side, keys in enumerate(named) for at, key in enumerate(keys)}

    def give(batches):
        for batch in batches:
            rows = [(*place[q, i], body) for q, i, body in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    if (q, i) in place]
            yield pa.RecordBatch.from_pydict({
                "side": pa.array([r[0] for r in rows], pa.int32()), "at": pa.array([r[1] for r in rows], pa.int32()),
                "part": pa.array([spread(r[2].encode("utf-8", "replace"), shares[r[0]]) for r in rows], pa.binary())})

    def measure(batches):
        sizer = Sizer(dictionaries)
        for batch in batches:
            rows = [(q, i, *sizer.features(body)) for q, i, body in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    if (q, i) not in place]
            types = {"quality": pa.int32(), "id": pa.int64(), "x": pa.float64(), "y": pa.float64()}
            yield pa.RecordBatch.from_pydict({name: pa.array([r[at] for r in rows], kind)
                                              for at, (name, kind) in enumerate(types.items())})

    texts = sample.select("quality", "id", "body")
    parts = sorted(tuple(r) for r in texts.mapInArrow(give, "side int, at int, part binary").collect())
    dictionaries = [b"\n".join(bytes(part) for own, _, part in parts if own == side) for side in (0, 1)]
    held = sorted(tuple(r) for r in texts.mapInArrow(measure, "quality int, id long, x double, y double").collect())
    x = np.array([r[2:] for r in held])
    y = np.array([float(r[0]) for r in held])
    means, scales = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = logistic((x - means) / scales, y)
    # The sample holds as many rows of either label as it may; the bias goes back to their true shares.
    share = y.mean()
    weights[0] += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    return QualityModel(dictionaries, weights.tolist(), means.tolist(), scales.tolist(), prior)


def score(docs: DataFrame, model: QualityModel, text="text", name="score") -> DataFrame:
    """The rows with their score between 0 and 1 added as `name`; all other columns are carried."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = plain_names([column for column in docs.columns if column != name])
    rows = docs.select(*[col(column).alias(short) for column, short in kept.items()], text_of(text).alias("result"))
    names = rows.columns

    def run(batches):
        own = sent.value
        sizer = Sizer(own.dictionaries)
        for batch in batches:
            scores = []
            for body in batch.column(len(kept)).to_pylist():
                if not body:
                    scores.append(own.prior)
                    continue
                z = own.weights[0] + sum(
                    w * (f - m) / s for w, f, m, s in zip(own.weights[1:], sizer.features(body), own.means, own.scales, strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=names)

    return rows.mapInArrow(run, rows.drop("result").schema.add("result", "double")).toDF(*kept, name)
