"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import weighyard
from weighyard.session import shared_dir

#: A lookup is broadcast up to this many estimated bytes, and shuffled beyond.
BROADCAST_BYTES = 16 << 20


#: Rows and bytes that a task passes to Python at a time. Spark's own default is 10,000 rows, which
#: for long texts are tens of megabytes, held several times over on both sides.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(BATCH_ROWS)),
            "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", f"{BATCH_BYTES}b")}

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Spark hand this package to the executors, once per application, and keep Arrow batches small.

    A batch size that the session sets itself is left alone.
    """
    context = spark.sparkContext
    for name, (usual, small) in _BATCHES.items():
        if spark.conf.get(name, None) == usual:
            spark.conf.set(name, small)
    if context.applicationId not in _SHIPPED:
        root = Path(weighyard.__file__).parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/weighyard", "zip", root.parent, root.name)
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


def give_back() -> None:
    """Return freed memory to the system. Workers are used again: what one operator leaves counts against the next."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run):
    """A function over batches that gives memory back when its partition is done."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str):
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain_names(columns: list[str]) -> dict[str, str]:
    """Each name with a plain one to stand for it: functions over batches take no dots or spaces in names."""
    return {name: f"c{at}_" for at, name in enumerate(columns)}


def text_of(column: str = "text"):
    """A null text counts as the empty text."""
    return F.coalesce(col(column).cast("string"), F.lit(""))


def original(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[col(name) for name in columns])


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files behind tables that are settled and no longer used.

    It does so once the driver has collected their garbage; loops ask for it after each round.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sized(lookup: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A settled lookup, marked for broadcast only when its counted rows fit into `most` bytes."""
    return F.broadcast(lookup) if lookup.count() * row_bytes <= most else lookup
