"""Best-fit packing with exact-complement hashing.

Documents become token pieces of at most `capacity` tokens. All decisions are taken on the
counts by length, at most `capacity` numbers, so planning does not grow with the corpus:

1. lengths are taken from the longest down; its gap is looked up in an index of single lengths,
   of sums of two and of sums of three; a combination that fills the gap exactly is consumed
   as often as the counts allow;
2. what is left is packed best-fit: the longest length first, then again and again the longest
   one that fits, each such pattern as often as the counts allow.

Every step exhausts a length or leaves less of it than one pattern takes, so the plan has a few
thousand rows at most and may be broadcast. A piece finds its place by its rank among the
pieces of its length; ranks come from windows within (partition, length) and running totals
over the partitions, so a length that half the pieces share is no hot spot.

Cases: a null or empty text is the end token alone. Repeated rows are packed as often as they
occur; null ids are carried. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weighyard.llm.common import col, settle, text_of, tidy

CAPACITY = 2048
#: Chunks that a task remembers between documents (some 200 bytes each); a full memory
#: forgets its older half, and the end of the task everything.
MEMORY = 400_000


class ChunkMemory(dict):
    """Token ids of white-space separated chunks as little-endian bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.merges = tokenizer, tokenizer.model

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= MEMORY:
            for old in list(islice(self, MEMORY // 2)):
                del self[old]
        if len(chunk) > 1 and chunk[-1] in b".," and chunk[-2:-1].isalnum():  # a word never includes its stop
            found = self[chunk[:-1]] + self[chunk[-1:]]
        elif chunk.isalpha():  # one word of a-z: the steps before the merges leave it as it is
            found = array("I", [t.id for t in self.merges.tokenize(chunk.decode())]).tobytes()
        else:
            ids = self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids
            found = array("I", ids).tobytes()
        self[chunk] = found
        return found


_LOADED: dict[str, ChunkMemory] = {}


def chunk_memory(path: str) -> ChunkMemory:
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = ChunkMemory(tokenizer)
    return _LOADED[path]


def token_bytes(text: str, memory: ChunkMemory) -> bytes:
    """The text's ids, 4 bytes each.

    White space separates words in every step of this vocabulary and is dropped, so chunks
    between ASCII white space are encoded on their own, in lower case as the vocabulary has them.
    Texts with what may be a special token are encoded whole.
    """
    if "<|" in text:
        return np.array(memory.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return b"".join(map(memory.__getitem__, text.encode().lower().split()))


def token_pieces(docs: DataFrame, vocabulary: str, capacity=CAPACITY, end_id=0, text="text",
                 doc_id="doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every document, cut only above `capacity`."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        memory = chunk_memory(vocabulary)
        try:
            for batch in batches:
                out = [[] for _ in range(5)]
                for ident, body in zip(batch["doc_id"].to_pylist(), batch["body"].to_pylist(), strict=True):
                    ids = token_bytes(body, memory) + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        for column, value in zip(out, (ident, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(column, pa.int32() if at == 1 else pa.int64())
                                       for at, column in enumerate(out)],
                                      names=["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            memory.clear()  # the worker may serve other operators next

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    return rows.mapInArrow(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_patterns(counts: dict[int, int], capacity=CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) that together use up all counts."""
    left = {length: n for length, n in counts.items() if n > 0}
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> int:
        uses = Counter(pattern)
        times = min(left.get(length, 0) // n for length, n in uses.items())
        if times:
            plan.append((pattern, times))
            for length, n in uses.items():
                left[length] -= n * times
                if not left[length]:
                    del left[length]
        return times

    if capacity in left:
        take((capacity,))
    for longest in sorted(left, reverse=True):
        gap = capacity - longest
        if longest in left and gap in left:
            take((longest, gap))
        if longest in left:  # two lengths, the longer first
            for first in [x for x in sorted(left, reverse=True) if gap // 2 <= x < gap]:
                if longest not in left:
                    break
                take((longest, first, gap - first))
        if longest in left:  # three lengths
            lengths = sorted((x for x in left if x < gap - 1), reverse=True)
            for first in lengths:
                if longest not in left:
                    break
                rest = gap - first
                second = next((x for x in lengths if x <= first and rest - x <= x and rest - x in left
                               and min(left.get(first, 0), left.get(x, 0)) > 0), None)
                if second is not None:
                    take((longest, first, second, rest - second))
    while left:
        uses: Counter = Counter()
        pattern, gap = [], capacity
        for length in sorted(left, reverse=True):
            n = min(left[length], gap // length)
            if n:
                uses[length] += n
                pattern += [length] * n
                gap -= n * length
        take(tuple(pattern))
    return plan


def placement(plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) for every slot of every pattern."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in plan:
        at = 0
        for length in pattern:
            rows.append((length, used[length], used[length] + times, sequence, at))
            used[length] += times
            at += length
        sequence += times
    return rows


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with `rank` from 0 within their length, without a task per length."""
    rows = pieces.withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.withColumn("row", F.row_number().over(inside)).join(totals, ["part", "length"]).withColumn(
        "rank", F.col("earlier") + F.col("row") - 1).drop("part", "row", "earlier")


def pack(pieces: DataFrame, capacity=CAPACITY) -> DataFrame:
    """Settled pieces with sequence_id and offset."""
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = pieces.sparkSession.createDataFrame(
        placement(plan_patterns(counts, capacity)),
        "place_length long, from_rank long, to_rank long, first_sequence long, offset long")
    return ranked(pieces).join(F.broadcast(places), (F.col("length") == F.col("place_length"))
                               & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))).select(
        *pieces.columns, (F.col("first_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity=CAPACITY, end_id=0, text="text",
                   doc_id="doc_id") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(settle(token_pieces(docs, vocabulary, capacity, end_id, text, doc_id)), capacity)
