"""Substring dedup by MinHash banding of paragraphs.

Passages repeat in two ways, so a text is cut into paragraphs in two ways:

* *Lines* of `LEAST_WORDS` words and more. They are long enough that a changed word leaves them alike, so
  they are compared by similarity: each gets MinHash values in `BANDS` bands of `ROWS`. At a
  similarity of 0.8 a pair shares a band with a probability of 1 - (1 - 0.8^ROWS)^BANDS, 0.993 as tuned here.
* *Pieces* cut by content, since a passage that was pasted into a text seldom starts or ends with a line: a
  piece ends before a word whose hash (with its neighbour) is the least within `RADIUS` words on either
  side. The same passage is cut at the same words wherever it stands, so pieces are compared by key.

1. Lines with equal shingle sets are one class; only classes are banded, and only buckets with two classes count.
2. In a few rounds, while they link enough, each class meets the leaders of its buckets; verified pairs join
   components. What is left between components is met exactly, family by family in blocks, many of them in
   one go (`families`), or, where very many classes are outside a family's head, bucket by bucket:
   every pair of classes that shares a bucket is verified or already in one component.
3. Pairs are verified by the exact Jaccard of their five-word shingles (as 56-bit hashes).
4. A component of lines, or a class of pieces, in two and more documents is repeated. Its occurrences in the
   document with the smallest id stay, the others are removals. Pieces inside a line that is removed as a
   near copy can't be the ones that stay, so what a removed line alone has in common with another
   document stays there. No piece ever leaves all documents unless every line that holds it is a near copy of
   a line that stays.
5. Neighbouring repeated pieces are one stretch; stretches under `LEAST_WORDS` words are left alone, since
   short phrases repeat by nature. A stretch is reported in passages, one for each keeper and verdict.

Cases: null and empty texts and texts under five words have no paragraphs. Null ids take no part, for
a passage must be told to be in two documents. Repeated rows count once; rows of one id with different
texts are told apart by a key of the text. A text that is one word over and over is one piece. An empty
table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weighyard.llm.common import BROADCAST_BYTES, col, original, release, settle, sized, text_of
from weighyard.llm.components import task_components
from weighyard.llm.families import family_table, packed_links
from weighyard.llm.jaccard_join import LEADER_ROUNDS, crossing_lists, leader_pairs, verified
from weighyard.llm.shingles import WIDTH, rolling, word_hashes, words

RADIUS = 5
BANDS, ROWS = 7, 3
LEAST_WORDS = 16
NUMERATOR, DENOMINATOR = 4, 5
#: Leaders are met again while a round links at least one in so many classes.
_WORTH = 20
#: Least shingles of a block of a family.
_LEAST_BLOCK = 1 << 16
#: Rows that a task turns into arrays at a time.
SLICE = 250
_ODD = np.array([2 * int(x) + 1 for x in np.random.default_rng(11).integers(0, 1 << 62, BANDS * ROWS)], np.uint64)
_ADD = np.array([int(x) for x in np.random.default_rng(12).integers(0, 1 << 62, BANDS * ROWS)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEYS = ["doc_id", "text_key"]


def cut(hashes: np.ndarray) -> np.ndarray:
    """First words of all pieces of a text, given its word hashes."""
    n = len(hashes)
    if n < 2 * RADIUS + 2:
        return np.zeros(1 if n else 0, np.int64)
    mixed = (hashes[1:] * _MIX) ^ (hashes[:-1] >> np.uint64(7))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
    seen = np.lib.stride_tricks.sliding_window_view(mixed, RADIUS)
    before, after = seen[:-RADIUS - 1].min(axis=1), seen[RADIUS + 1:].min(axis=1)
    centre = mixed[RADIUS:-RADIUS]
    at = np.nonzero((centre < before) & (centre <= after))[0] + RADIUS + 1
    return np.concatenate([[0], at])


def line_starts(text: str) -> np.ndarray:
    """First words of all lines that have words."""
    sizes = np.array([len(line.split()) for line in text.encode().split(b"\n")])
    sizes = sizes[sizes > 0]
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.empty(0, np.int64)


def shingled(starts: np.ndarray, hashes: np.ndarray, least: int):
    """(starts, ends, sizes, shingles in order, first shingle of each) of the parts with `least` words and more."""
    ends = np.append(starts[1:], len(hashes))[:len(starts)]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return starts, ends, starts, np.empty(0, np.uint64), starts
    every = rolling(hashes)
    sizes = ends - starts - WIDTH + 1
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside = np.arange(sizes.sum()) - np.repeat(first - starts, sizes)
    return starts, ends, sizes, every[inside], first


def _spread(shingles: np.ndarray) -> np.ndarray:
    mixed = (shingles + np.uint64(1)) * _MIX
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def part_keys(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 63-bit key of the shingles of each part."""
    return (np.add.reduceat(_spread(shingles), first) & np.uint64((1 << 63) - 1)).view(np.int64)


def band_hashes(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash per part and band."""
    mixed, bands = _spread(shingles), []
    for band in range(BANDS):
        folded = np.full(len(first), band + 1, np.uint64)
        for row in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat(mixed * _ODD[row] + _ADD[row], first)
            folded = (folded ^ least) * _MIX
            folded ^= folded >> np.uint64(32)
        bands.append(folded)
    return np.stack(bands, axis=1).view(np.int64)


def _source(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body")).where("doc_id IS NOT NULL")
    return rows.withColumn("text_key", F.xxhash64("body"))


def _parts(docs: DataFrame, make, schema: str, names: list[str]) -> DataFrame:
    """`make(text)` gives arrays, one row per part; ids and text keys are put before them."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, out = batch.slice(at, SLICE), []
                for ident, key, body in zip(*[part[n].to_pylist() for n in ("doc_id", "text_key", "body")], strict=True):
                    made = make(body)
                    if len(made[0]):
                        out.append((np.full(len(made[0]), ident), np.full(len(made[0]), key), *made))
                if out:
                    columns = []
                    for whole in (np.concatenate(column) for column in zip(*out)):
                        if whole.ndim == 2:
                            ends = np.arange(0, whole.size + 1, whole.shape[1], dtype=np.int32)
                            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(whole.ravel())))
                        else:
                            columns.append(pa.array(whole))
                    yield pa.RecordBatch.from_arrays(columns, names=[*_KEYS, *names])

    return docs.mapInArrow(run, f"doc_id long, text_key long, {schema}")


def _lines(text: str):
    """(line, start, end, class, bands) of the long lines."""
    hashes = word_hashes(words(text))
    every = line_starts(text)
    starts, ends, _, shingles, first = shingled(every, hashes, LEAST_WORDS)
    if not len(starts):
        return (starts,)
    return (np.searchsorted(every, starts), starts, ends, part_keys(shingles, first), band_hashes(shingles, first))


def _pieces(text: str):
    """(number, start, end, class, line) of the pieces; `line` is -1 where a piece is not inside one line."""
    hashes = word_hashes(words(text))
    starts, ends, _, shingles, first = shingled(cut(hashes), hashes, WIDTH)
    if not len(starts):
        return (starts,)
    lines = line_starts(text)
    line = np.searchsorted(lines, starts, "right") - 1
    inside = line == np.searchsorted(lines, ends - 1, "right") - 1
    return np.arange(len(starts)), starts, ends, part_keys(shingles, first), np.where(inside, line, -1)


def line_rows(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """(doc_id, text_key, line, start, end, class, bands): all long lines; places are counted in words."""
    return _parts(_source(docs, text, doc_id), _lines, "line long, start long, end long, class long, bands array<long>",
                  ["line", "start", "end", "class", "bands"])


def piece_rows(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """(doc_id, text_key, number, start, end, class, line): all pieces."""
    return _parts(_source(docs, text, doc_id), _pieces, "number long, start long, end long, class long, line long",
                  ["number", "start", "end", "class", "line"])


def line_sets(docs: DataFrame, homes: DataFrame, few: bool, text="text", doc_id="doc_id") -> DataFrame:
    """(class, n, shingles) of the classes in `homes` (class, home), read again from their home documents."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, keys, sets = batch.slice(at, SLICE), [], []
                for body, classes in zip(part["body"].to_pylist(), part["classes"], strict=True):
                    _, _, sizes, shingles, first = shingled(line_starts(body), word_hashes(words(body)), LEAST_WORDS)
                    if not len(first):
                        continue
                    found, where = np.unique(part_keys(shingles, first), return_index=True)
                    mine = np.isin(found, classes.values.to_numpy())
                    keys.append(found[mine])
                    sets += [np.unique(shingles[first[i]:first[i] + sizes[i]]).view(np.int64) for i in where[mine]]
                if sets:
                    ends = np.cumsum([0] + [len(x) for x in sets], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), pa.array(np.diff(ends)),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["class", "n", "shingles"])

    grouped = settle(homes.groupBy("home").agg(F.collect_list("class").alias("classes")))
    read = _source(docs, text, doc_id).select(F.col("doc_id").alias("home"), "body").join(
        F.broadcast(grouped) if few else grouped, "home")
    return read.select("body", "classes").mapInArrow(run, "class long, n int, shingles array<long>").dropDuplicates(["class"])


def near_components(classes: DataFrame, docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """(node, component) of line classes (class, least, bands) that are linked by similarity."""
    met = classes.select(F.explode("bands").alias("shingle"), "class")
    crowded = settle(met.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high"))
    lists = settle(met.join(sized(crowded.select("shingle"), 16), "shingle"))
    wanted = settle(lists.select("class").distinct())
    many = wanted.count()
    homes = classes.select("class", F.col("least").alias("home")).join(sized(wanted, 16), "class", "left_semi")
    # A document has one class at least.
    sets = settle(line_sets(docs, homes, many * 40 <= BROADCAST_BYTES, text, doc_id))
    found = None
    for turn in range(LEADER_ROUNDS):
        near = settle(verified(leader_pairs(crossing_lists(lists, found), turn), sets))
        links = near.count()
        if links:
            found = task_components(_joined(found, near))
        release(docs.sparkSession)
        if links * _WORTH < many:  # the rest is as well met by family
            break
    left = settle(crossing_lists(lists, found))
    families = family_table(left, sets, task_components, _LEAST_BLOCK)
    near = settle(packed_links(families, sets, NUMERATOR, DENOMINATOR))
    # Families whose queries fit are settled in blocks; the others are joined bucket by bucket.
    large = families.where("NOT fits").select("class")
    if not large.isEmpty():
        apart = left.join(large, "class", "left_semi")
        other = apart.select("shingle", F.col("class").alias("b"), F.col("component").alias("theirs"))
        pairs = apart.withColumnRenamed("class", "a").join(other, "shingle").where("a < b AND component <> theirs").select("a", "b").distinct()
        near = near.union(verified(pairs, sets))
    return task_components(_joined(found, near))


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    return links if found is None else found.where("node <> component").select(
        F.col("node").alias("a"), F.col("component").alias("b")).union(links)


def repeated_lines(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """(doc_id, text_key, line, start, end, component, keep_doc, removed) of lines that repeat across documents."""
    rows = settle(line_rows(docs, text, doc_id))
    classes = settle(rows.groupBy("class").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("bands").alias("bands")))
    linked = near_components(classes, docs, text, doc_id)
    release(docs.sparkSession)
    placed = classes.drop("bands").join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class"))
    groups = placed.groupBy("component").agg(F.min("least").alias("keep_doc"), F.max("most").alias("most")).where("keep_doc < most")
    repeated = settle(placed.select("class", "component").join(groups.select("component", "keep_doc"), "component"))
    return settle(rows.drop("bands").join(sized(repeated, 40), "class").drop("class").distinct().withColumn(
        "removed", F.col("keep_doc") < F.col("doc_id")))


def repeated_pieces(docs: DataFrame, lines: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """(doc_id, text_key, number, start, end, component, keep_doc, removed) of pieces that repeat, outside removed lines."""
    rows = settle(piece_rows(docs, text, doc_id))
    spread = rows.groupBy("class").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    repeated = settle(spread.select("class"))
    found = rows.join(sized(repeated, 16), "class").distinct()
    gone = sized(settle(lines.where("removed").select(*_KEYS, "line")), 32).withColumn("gone", F.lit(True))
    found = settle(found.join(gone, [*_KEYS, "line"], "left").where("gone IS NULL").drop("gone", "line"))
    keepers = found.groupBy("class").agg(F.min("doc_id").alias("keep_doc"), F.max("doc_id").alias("most")).where(
        "keep_doc < most").select("class", "keep_doc")
    return found.join(sized(settle(keepers), 24), "class").withColumnRenamed("class", "component").withColumn(
        "removed", F.col("keep_doc") < F.col("doc_id"))


def _passages(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    lines = repeated_lines(docs, text, doc_id)
    pieces = repeated_pieces(docs, lines, text, doc_id)
    in_text = Window.partitionBy(*_KEYS).orderBy("number")
    runs = pieces.withColumn("stretch", F.col("number") - F.row_number().over(in_text))
    # A new passage begins where the keeper changes; the verdict follows the keeper.
    of_stretch = Window.partitionBy(*_KEYS, "stretch")
    runs = runs.withColumn("words", F.sum(F.col("end") - F.col("start")).over(of_stretch)).where(F.col("words") >= LEAST_WORDS)
    changed = F.coalesce((F.lag("keep_doc").over(of_stretch.orderBy("number")) != F.col("keep_doc")).cast("int"), F.lit(0))
    runs = runs.withColumn("changed", changed).withColumn(
        "passage", F.sum("changed").over(of_stretch.orderBy("number")))
    passages = runs.groupBy(*_KEYS, "stretch", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("component").alias("component"),
        F.min("keep_doc").alias("keep_doc"), F.max("removed").alias("removed")).drop("stretch", "passage")
    columns = [*_KEYS, "start", "end", "component", "keep_doc", "removed"]
    return lines.select(*columns).union(passages.select(*columns)).withColumn("words", F.col("end") - F.col("start"))


def repeated_passages(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """Passages that repeat across documents: doc_id, start, end (words), words, component, keep_doc, removed.

    Passages of lines and of pieces may overlap. Documents without such a passage have no row.
    """
    return _passages(docs, text, doc_id).select("doc_id", "start", "end", "words", "component", "keep_doc", "removed")


_WORD = re.compile(r"[^\x20\t-\r]+")


def without(body: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the words in `cuts` (start, end); words next to a cut are joined by one space."""
    places = [m.span() for m in _WORD.finditer(body)]
    kept, at, last = [], 0, 0
    for start, end in sorted(cuts):
        if end > last:
            start = max(start, last)
            kept.append(body[at:places[start][0]].rstrip())
            at, last = places[end - 1][1], end
    return " ".join(x for x in (*kept, body[at:].lstrip()) if x).strip()


def drop_repeats(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """The rows with removals cut out of their texts and all columns as they were; texts without a removal stay, also nulls."""
    columns = docs.columns
    short = {name: f"c{at}" for at, name in enumerate(columns)}
    removals = settle(_passages(docs, text, doc_id).where("removed").groupBy(*_KEYS).agg(
        F.collect_list(F.struct("start", "end")).alias("cuts")))
    rows = docs.select(*[col(name).alias(alias) for name, alias in short.items()]).withColumn(
        "doc_id", F.col(short[doc_id]).cast("long")).withColumn("text_key", F.xxhash64(text_of(short[text])))
    joined = rows.join(removals, _KEYS, "left").drop(*_KEYS)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(short[text])
            out = [body if not cuts else without(body, [(c["start"], c["end"]) for c in cuts])
                   for body, cuts in zip(batch.column(at).to_pylist(), batch["cuts"].to_pylist(), strict=True)]
            arrays = [pa.array(out, pa.string()) if n == at else batch.column(n) for n in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=list(short.values()))

    schema = joined.drop("cuts").schema
    return original(joined.mapInArrow(run, schema).select(
        *[F.col(alias).alias(name) for name, alias in short.items()]), columns)
