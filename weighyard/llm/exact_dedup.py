"""Exact dedup: counting quotient filters per partition, merged by sorted remainders.

A row's fingerprint is the 64-bit hash of its whole text. Every partition keeps its
fingerprints in counting quotient filters, one per segment (the leading bits, as many as the number
of rows needs): the next bits are the quotient, which names a run, and the rest is the
remainder; a run holds its remainders in order, each once, with a count. Filters of one
segment merge without loss: two sorted sequences are interleaved, counts of equal remainders
added, pair by pair, so a text that fills a third of the table arrives once per partition. A fingerprint seen once belongs to a text
without copies. Fingerprints with a higher count go on to the byte verification, where
whole texts are compared.

Cases: null text is the empty text, and all empty texts are copies of each other. Null ids lose
against any other; a group of null ids alone keeps the null id. A row repeated with its id is
reported as often as it occurs; `drop_copies` leaves one of them. An empty table gives an
empty result. Other columns are carried by `drop_copies` and ignored by `copies`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighyard.llm.common import col, original, settle, sized, text_of, tidy

#: Fingerprints of a segment, about, and its leading bits at least.
SEGMENT_ROWS, SEGMENT_BITS = 1 << 22, 10
QUOTIENT_BITS = 22
_FILTER = "segment int, quotients binary, lengths binary, remainders binary, counts binary"


def segment_bits(rows: int) -> int:
    """Leading bits that cut so many fingerprints into segments of about SEGMENT_ROWS."""
    return max(SEGMENT_BITS, (max(0, rows - 1) // SEGMENT_ROWS).bit_length())


def counted(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints in order, each once, with their counts."""
    values, counts = np.unique(fingerprints, return_counts=True)
    return values, counts.astype(np.int64)


def merged(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted sequence of two; counts of equal fingerprints are added."""
    (a, n), (b, m) = left, right
    if not len(a) or not len(b):
        return right if not len(a) else left
    at = np.searchsorted(a, b)
    same = a[np.minimum(at, len(a) - 1)] == b
    n = n.copy()
    n[at[same]] += m[same]
    # Each new value moves behind the smaller ones of the other side and the new ones before it.
    to = at[~same] + np.arange(len(b) - np.count_nonzero(same))
    values, counts = np.empty(len(a) + len(to), np.uint64), np.empty(len(a) + len(to), np.int64)
    old = np.ones(len(values), bool)
    old[to] = False
    values[to], counts[to] = b[~same], m[~same]
    values[old], counts[old] = a, n
    return values, counts


def merged_all(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All sequences in one, neighbours first, so that every fingerprint moves a logarithmic number of times."""
    while len(parts) > 1:
        parts = [merged(*parts[at:at + 2]) if at + 1 < len(parts) else parts[at] for at in range(0, len(parts), 2)]
    return parts[0] if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def build_filters(fingerprints: np.ndarray, counts: np.ndarray | None = None, bits: int = SEGMENT_BITS):
    """One filter per segment: occupied quotients, run lengths, remainders in order, counts.

    With counts, fingerprints are in order and each occurs once.
    """
    values, sums = counted(fingerprints) if counts is None else (fingerprints, counts)
    remainder = 64 - bits - QUOTIENT_BITS
    segments = (values >> np.uint64(64 - bits)).astype(np.int64)
    for segment in np.unique(segments):
        inside = slice(*np.searchsorted(segments, [segment, segment + 1]))
        rest = values[inside] & np.uint64((1 << (64 - bits)) - 1)
        quotients, lengths = np.unique(rest >> np.uint64(remainder), return_counts=True)
        remainders = rest & np.uint64((1 << remainder) - 1)
        yield (int(segment), quotients.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
               remainders.astype("<u4").tobytes(), sums[inside].astype("<i8").tobytes())


def read_filter(segment, quotients, lengths, remainders, counts, bits: int = SEGMENT_BITS):
    """The fingerprints and counts that a filter holds, in order."""
    runs = np.repeat(np.frombuffer(quotients, "<u4"), np.frombuffer(lengths, "<u4")).astype(np.uint64)
    high = np.uint64(int(segment) << (64 - bits))
    return (high | (runs << np.uint64(64 - bits - QUOTIENT_BITS)) | np.frombuffer(remainders, "<u4").astype(np.uint64),
            np.frombuffer(counts, "<i8"))


def _partition_filters(bits: int):
    """Filters of one partition; memory holds distinct fingerprints only."""
    def run(batches):
        parts: list = []
        for batch in batches:
            parts.append(counted(batch["fingerprint"].to_numpy(np.int64).view(np.uint64)))
            # Like a binary counter: a part meets one of at least its size.
            while len(parts) > 1 and len(parts[-2][0]) <= 2 * len(parts[-1][0]):
                parts[-2:] = [merged(*parts[-2:])]
        yield pd.DataFrame(list(build_filters(*merged_all(parts[::-1]), bits)),
                           columns=["segment", "quotients", "lengths", "remainders", "counts"])
    return run


def _merge_segment(filters: pd.DataFrame, bits: int = SEGMENT_BITS) -> pd.DataFrame:
    values, counts = merged_all([read_filter(*row, bits=bits) for row in filters.itertuples(index=False, name=None)])
    return pd.DataFrame({"fingerprint": values[counts > 1].view(np.int64), "copies": counts[counts > 1]})


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fingerprint, copies) of all fingerprints that occur more than once."""
    bits = segment_bits(fingerprints.count())
    filters = fingerprints.select("fingerprint").mapInPandas(tidy(_partition_filters(bits)), _FILTER)
    return filters.groupBy("segment").applyInPandas(
        lambda rows: _merge_segment(rows, bits), "fingerprint long, copies long")


def copy_groups(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """Verified groups of two and more rows: text_sha256, keep_id, group_size.

    Equal texts of a partition are combined before they are shuffled, so no task compares more
    than one copy of a text per partition.
    """
    rows = docs.select(col(doc_id).cast("long").alias("id"), text_of(text).alias("body"))
    rows = rows.withColumn("fingerprint", F.xxhash64("body"))
    repeated = settle(repeated_fingerprints(rows))
    suspects = rows.join(sized(repeated.select("fingerprint"), 16), "fingerprint", "left_semi")
    groups = suspects.groupBy("fingerprint", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.where("group_size > 1").select(F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")


def copies(docs: DataFrame, text="text", doc_id="doc_id", groups: DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = settle(copy_groups(docs, text, doc_id)) if groups is None else groups
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.sha2(text_of(text), 256).alias("text_sha256"))
    groups = groups.select("text_sha256", F.col("keep_id").alias("found"), F.col("group_size").alias("size"))
    return rows.join(sized(groups, 120), "text_sha256", "left").select(
        "doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("found")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("size").isNull() | F.col("doc_id").eqNullSafe(F.col("found"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """The rows that stay, with all their columns."""
    columns = docs.columns
    groups = settle(copy_groups(docs, text, doc_id))
    named = {name: f"c{at}" for at, name in enumerate(columns)}
    rows = docs.select(*[col(name).alias(short) for name, short in named.items()])
    rows = rows.withColumn("text_sha256", F.sha2(text_of(named[text]), 256))
    joined = rows.join(sized(groups, 120), "text_sha256", "left")
    kept = joined.where(F.col("group_size").isNull() | F.col(named[doc_id]).cast("long").eqNullSafe(F.col("keep_id")))
    again = kept.where("group_size IS NOT NULL").groupBy("text_sha256").count().where("count > 1")
    if not again.isEmpty():  # the same row twice: any of them
        kept = kept.dropDuplicates(["text_sha256"])
    return original(kept.select(*[F.col(short).alias(name) for name, short in named.items()]), columns)
