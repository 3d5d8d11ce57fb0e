"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors are brought to a grid of integers, so equal vectors, sums and deviations are exact. The fit
list holds each distinct grid vector once. Its covariance is never formed: the only thing done with
the rows is a pass that multiplies the centred rows with a narrow block, XᵀXQ, added up over blocks
of rows in a tree. The rest, a few numbers per dimension, happens on the driver:

* a Chebyshev polynomial of the covariance, by its three-term recurrence, damps the spectrum between
  zero and the smallest Ritz value of the block and lets the wanted part grow;
* QR and Rayleigh-Ritz turn the filtered block into approximate eigenvectors;
* this goes on until the residuals |VQ - Qθ| of the wanted pairs are certified to be at rounding level.

Defined results: vectors that are null, hold a null or non-finite entry, or an entry of more than
2**45 in size, take no part. Of vectors of several lengths only the most frequent length takes part
(ties: the greater). Repeated rows each get a result; an empty table gives an empty one. Components
whose eigenvalue is below 1e-12 of the trace don't exist, so a table of one distinct vector has none.
Further columns are ignored; the result has the id and its own columns only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weighyard.llm.common import col, settle

COMPONENTS = 4
GRID = 256
#: Vectors in the iterated block; what the block holds beyond the components widens the damped gap.
BLOCK = 32
#: Degree of the filter, that is passes over the rows between two Rayleigh-Ritz steps.
DEGREE = 12
#: Residual of a certified pair, as a share of the largest eigenvalue.
CERTIFIED = 1e-13
#: Accepted where rounding allows no more: residuals that have stopped falling below this share.
STALLED = 1e-10
ROUNDS = 60
#: Bytes of a block of rows in a pass, and rows of partial sums that one task or the driver adds up.
PASS_BYTES = 16 << 20
FAN_IN = 32


@dataclass
class Whitening:
    """Mean and scaled directions; small, whatever the number of rows."""
    rows: int
    sums: list[int]
    eigenvalues: np.ndarray
    directions: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int


def on_grid(df: DataFrame, column: str, grid: int = GRID) -> DataFrame:
    """The usable rows with their integer vector `_x`."""
    vector = col(column)
    usable = F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= 2.0**45)), F.lit(False))
    kept = df.where(usable & (F.size(vector) > 0))
    lengths = kept.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    whole = kept.where(F.size(vector) == (most.d if most else 0))
    return whole.withColumn("_x", F.transform(vector, lambda c: F.floor(c.cast("double") * grid).cast("bigint")))


def _matrix(array: pa.ListArray) -> np.ndarray:
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)


def _blocks(batches):
    """Integer matrices of at most PASS_BYTES."""
    for batch in batches:
        rows = _matrix(batch.column(0))
        if len(rows):
            step = max(1, PASS_BYTES // (8 * rows.shape[1]))
            for start in range(0, len(rows), step):
                yield rows[start:start + step]


def _one_row(values: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], ["part"])


def _add(batches):
    total = None
    for batch in batches:
        for part in batch.column(0).to_pylist():
            values = np.frombuffer(part)
            total = values if total is None else total + values
    if total is not None:
        yield _one_row(total)


def _summed(fit: DataFrame, partitions: int, kernel) -> np.ndarray:
    """The sum of kernel(block) over all blocks of rows, added up FAN_IN partial sums at a time."""
    def partial(batches):
        total = None
        for block in _blocks(batches):
            values = kernel(block)
            total = values if total is None else total + values
        if total is not None:
            yield _one_row(total)

    parts = fit.mapInArrow(partial, "part binary")
    while partitions > FAN_IN:
        partitions = math.ceil(partitions / FAN_IN)
        parts = parts.repartition(partitions).mapInArrow(_add, "part binary")
    return np.sum([np.frombuffer(row.part) for row in parts.collect()], axis=0)


def _exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    n = fit.count()
    sums = fit.select(F.posexplode("_x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(28,0)")).alias("s"))
    return n, [int(row.s) for row in sums.orderBy("pos").collect()]


def filtered(apply, start, image, theta, wanted, degree):
    """The Chebyshev polynomial of the operator on a block, scaled to 1 at the largest Ritz value.

    `image` is the operator's product with `start`, known from the Rayleigh-Ritz step before.
    """
    edge = float(np.clip(theta[-1], 0.25 * theta[wanted - 1], 0.98 * theta[wanted - 1]))
    centre = half = edge / 2
    sigma = first = half / (theta[0] - centre)
    before, now = start, (image - centre * start) * (first / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - centre * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors `_x`; None without any row or direction."""
    fit = settle(rows.select("_x").distinct())
    n, sums = _exact_sums(fit)
    if not n:
        return None
    d = len(sums)
    # Small tables come in many nearly empty partitions; a pass needs one per block of rows.
    partitions = min(fit.rdd.getNumPartitions(),
                     max(fit.sparkSession.sparkContext.defaultParallelism, math.ceil(n * d * 8 / (4 * PASS_BYTES))))
    fit = fit.coalesce(partitions)
    mean = np.array([float(s) for s in sums]) / n
    passes = 0

    def apply(block):
        nonlocal passes
        passes += 1

        def kernel(x):
            centred = x - mean
            return (centred.T @ (centred @ block)).ravel()
        return _summed(fit, partitions, kernel).reshape(block.shape) / n

    trace = float(_summed(fit, partitions, lambda x: np.array([np.square(x - mean).sum()]))[0]) / n
    if trace <= 0:
        return None
    width = min(BLOCK, d)
    block = np.linalg.qr(np.random.default_rng(7).standard_normal((d, width)))[0]
    residuals = []
    for _ in range(ROUNDS):
        image = apply(block)
        small = block.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        wanted = int((theta[:components] > 1e-12 * trace).sum())
        gone = image[:, :wanted] - block[:, :wanted] * theta[:wanted]
        residuals.append(float(np.linalg.norm(gone, axis=0).max() / theta[0]))
        stalled = len(residuals) > 4 and min(residuals[-3:]) >= min(residuals[:-3]) and residuals[-1] <= STALLED
        if residuals[-1] <= CERTIFIED or stalled:
            break
        block = np.linalg.qr(filtered(apply, block, image, theta, wanted, DEGREE))[0]
    else:
        raise RuntimeError(f"no certified eigenvectors after {ROUNDS} rounds: residuals {residuals[-3:]}")
    values, directions = theta[:wanted], block[:, :wanted]
    # Either sign is an eigenvector: the entry largest in size is positive.
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(wanted)])
    scaled = directions / np.sqrt(values)

    def moments(x):
        z = (x - mean) @ scaled
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    found = _summed(fit, partitions, moments) / n
    middle = found[wanted * wanted:]
    covariance = found[:wanted * wanted].reshape(wanted, wanted) - np.outer(middle, middle)
    error = float(np.abs(covariance - np.eye(wanted)).max())
    return Whitening(n, sums, values, directions, trace, error, residuals[-1], passes)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n*x - S)**2 in whole numbers."""
    most = float(np.abs(x).max())
    total = max(1.0, max(abs(float(s)) for s in sums))
    if most * max(most, total) * x.shape[1] < 2.0**62:
        squares, products = np.square(x).sum(axis=1), x @ np.array(sums, np.int64)
    else:
        whole = x.astype(object)
        squares, products = (whole * whole).sum(axis=1), whole @ np.array(sums, object)
    rest = sum(s * s for s in sums)
    return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(squares, products)]


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    `deviation` is a decimal of 38 digits; the other columns are as the module says.
    """
    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), *T.StructType.fromDDL(
        "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")])
    rows = on_grid(df.select(col(id_column), col(vector_column)), vector_column)
    model = fit_whitening(rows, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    mean = np.array([float(s) for s in model.sums]) / model.rows
    scaled = model.directions / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace
    out_types = [pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.float64(), pa.float64(), pa.float64()]

    def project(batches):
        from decimal import Decimal

        k = len(explained)
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            deviations = pa.array([Decimal(v) for v in _deviations(x, model.rows, model.sums)], pa.decimal128(38, 0))
            at = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(x) * k, model.rows, np.int64), None,
                ((x - mean) @ scaled).ravel(), np.tile(explained, len(x)), np.full(len(x) * k, model.identity_error)]
            arrays = [deviations.take(at) if c is None else pa.array(c, t) for c, t in zip(columns, out_types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *arrays], names=schema.names)

    return rows.select(col(id_column), "_x").mapInArrow(project, schema)
