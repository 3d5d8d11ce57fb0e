"""Language-model scores of texts from a log-bilinear model trained by noise-contrastive estimation.

Tokens are words between ASCII white space, A-Z in lower case, and one end of text. The model predicts a
token's class from the classes of the two tokens before it, and the token within its class by smoothed
counts, so a text's probability is normalised over all known words and one unknown word a class:

* each of the SHORTLIST most frequent tokens is a class of its own, any other word belongs to one of
  SPELLINGS classes by a hash of its last letters;
* log-bilinear: p = C1·r(w-1) + C2·r(w-2), score of class v = p·q(v) + b(v), normalised by the matrix
  product of all contexts of a batch with all classes;
* training by noise-contrastive estimation: each n-gram of the corpus against NOISE classes drawn from
  the unigram distribution.

How it runs: words are counted over all training texts (partial counts in the tasks, one shuffle), then
class n-grams are counted over all training texts. Every epoch deals all distinct n-grams with their
counts over tasks; each task runs its share with numpy from the common parameters, and their mean,
weighted by n-grams, is the next common state. The parameters and the most frequent words, at most HEAD, are small
by parameter and go to the tasks; the counts of all other words stay in a table that the rare words of
the texts are joined to.

Defined results: a null text is empty and has the end only. Without training texts all counts are 0 and
the model is uniform. Rows with repeated or null ids each get their own result. Texts are read as bytes,
so any content is defined. Further columns are carried unless named like a result, when the result wins.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weighyard.llm.common import col, text_of
from weighyard.session import scratch_path

SHORTLIST = 512
SPELLINGS = 63
ENDING = 3
HEAD = 65_536
DIM = 24
#: Noise samples per n-gram, and noise classes drawn for a batch of n-grams.
NOISE = 16
SHARED = 96
EPOCHS = 4
RATE = 0.05
BATCH = 2048
PORTION = 32
#: Words counted in a task before it hands on its counts, and bytes of a text that are split at a time.
COUNTED = 400_000
PIECE = 1 << 20
#: Tokens scored at a time.
TOKENS = 1 << 18
END = b""
LN10 = float(np.log(10))

RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def token_lists(text: bytes):
    """The tokens of a text in lists of bounded size, the end last."""
    start, most = 0, len(text)
    while most - start > PIECE:
        found = _SPACE.search(text, start + PIECE)
        stop = found.start() if found else most
        yield text[start:stop].lower().split()
        start = stop
    yield [*text[start:].lower().split(), END]


class Classes:
    """Words to classes; the most frequent words and their counts are kept in a dictionary."""

    def __init__(self, head: list[tuple[bytes, int]], shortlist: int, spellings: int):
        self.shortlist = min(shortlist, len(head))
        self.spellings = spellings
        self.count = self.shortlist + spellings
        self.head = {word: k for k, (word, _) in enumerate(head)}
        self.counts = np.array([c for _, c in head], np.float64)
        self.of_head = np.array([k if k < self.shortlist else self.shortlist + zlib.crc32(word[-ENDING:]) % spellings
                                 for k, (word, _) in enumerate(head)], np.int64)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place in the head or -1, class) of each word."""
        places = np.fromiter(map(self.head.get, words, repeat(-1)), np.int64, len(words))
        classes = self.of_head[places] if len(self.of_head) else np.empty(len(words), np.int64)
        rare = np.nonzero(places < 0)[0]
        classes[rare] = [self.shortlist + zlib.crc32(words[j][-ENDING:]) % self.spellings for j in rare.tolist()]
        return places, classes


def contexts(classes: np.ndarray, before: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The classes two places and one place before each token."""
    padded = np.concatenate([np.array(before, np.int64), classes])
    return padded[:-2], padded[1:-1]


def _texts(batches):
    for batch in batches:
        for text in batch.column(0):
            yield text.as_py() or b""


def _count_words(batches):
    held: Counter = Counter()

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                          names=["word", "c"])
    for text in _texts(batches):
        for words in token_lists(text):
            held.update(words)
        if len(held) > COUNTED:
            yield flush()
            held.clear()
    if held:
        yield flush()


def _count_ngrams(classes: Classes):
    k = classes.count

    def run(batches):
        codes, held = [], 0

        def flush():
            found, counts = np.unique(np.concatenate(codes), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.astype(np.int64))], names=["code", "c"])

        for text in _texts(batches):
            before = (k, k)
            for words in token_lists(text):
                ids = classes(words)[1]
                if not len(ids):
                    continue
                two, one = contexts(ids, before)
                codes.append((two * (k + 1) + one) * k + ids)
                before = tuple([*before, *ids[-2:].tolist()][-2:])
                held += len(ids)
            if held > 8 * TOKENS:
                yield flush()
                codes, held = [], 0
        if held:
            yield flush()

    return run


@dataclass
class Model:
    """Log-bilinear parameters: context vectors r (with one of the start), weights of the two places, q and b of classes."""
    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    q: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(unigram: np.ndarray) -> Model:
        rng = np.random.default_rng(11)
        k = len(unigram)
        return Model(rng.normal(0, 0.1, (k + 1, DIM)), np.full(DIM, 1.0), np.full(DIM, 0.5),
                     rng.normal(0, 0.1, (k, DIM)), np.log(unigram))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.r.ravel(), self.c1, self.c2, self.q.ravel(), self.b])

    @staticmethod
    def unflat(values: np.ndarray, k: int) -> Model:
        r, c1, c2, q, b = np.split(values, np.cumsum([(k + 1) * DIM, DIM, DIM, k * DIM]))
        return Model(r.reshape(k + 1, DIM), c1, c2, q.reshape(k, DIM), b)

    def predicted(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return self.r[one] * self.c1 + self.r[two] * self.c2

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of every class by the class one place and two places before, and the log normaliser by both.

        exp(x + y) = exp(x) exp(y), so the normalisers of all contexts are one matrix product.
        """
        one, two = (self.r * self.c1) @ self.q.T, (self.r * self.c2) @ self.q.T + self.b
        top_one, top_two = one.max(axis=1), two.max(axis=1)
        norms = np.exp(two - top_two[:, None]) @ np.exp(one - top_one[:, None]).T
        return one, two, np.log(norms) + top_two[:, None] + top_one[None, :]


def _sum_rows(size: int, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of `values` added up by place."""
    places = places.astype(np.uint16 if size <= 65536 else np.int64)
    order = np.argsort(places, kind="stable")
    at, first = np.unique(places[order], return_index=True)
    out = np.zeros((size, values.shape[1]))
    out[at] = np.add.reduceat(values[order], first, axis=0)
    return out


def nce_steps(model: Model, memory: np.ndarray, codes, counts, noise: np.ndarray, rng, rate: float) -> Model:
    """Minibatch ascent (Adagrad, squares in `memory`) of the NCE objective over n-grams with their counts.

    A frequent n-gram comes in several portions of at most PORTION, spread over the batches. Every
    batch draws SHARED noise classes; each stands for NOISE / SHARED noise samples of every n-gram.
    """
    k = len(noise)
    portions = -(-counts // PORTION)
    rows = rng.permutation(np.repeat(np.arange(len(codes)), portions))
    weights, words, rest = counts / portions, codes % k, codes // k
    log_noise, edges, values = np.log(noise * NOISE), np.cumsum(noise), model.flat()
    for start in range(0, len(rows), BATCH):
        chosen = rows[start:start + BATCH]
        weight = weights[chosen] / weights[chosen].sum()
        word, two, one = words[chosen], rest[chosen] // (k + 1), rest[chosen] % (k + 1)
        drawn = np.minimum(np.searchsorted(edges, rng.random(SHARED)), k - 1)
        model = Model.unflat(values, k)
        predicted, own, others = model.predicted(two, one), model.q[word], model.q[drawn]
        true = np.einsum("nd,nd->n", predicted, own) + model.b[word] - log_noise[word]
        false = predicted @ others.T + model.b[drawn] - log_noise[drawn]
        # Slopes of log(sigmoid) at the data and of log(1 - sigmoid) at the noise.
        up = weight / (1 + np.exp(np.clip(true, -40, 40)))
        down = -(NOISE / SHARED) * weight[:, None] / (1 + np.exp(-np.clip(false, -40, 40)))
        back = up[:, None] * own + down @ others
        grad = np.concatenate([
            _sum_rows(k + 1, np.concatenate([one, two]), np.concatenate([back * model.c1, back * model.c2])).ravel(),
            (back * model.r[one]).sum(axis=0), (back * model.r[two]).sum(axis=0),
            _sum_rows(k, np.concatenate([word, drawn]), np.concatenate([up[:, None] * predicted, down.T @ predicted])).ravel(),
            np.bincount(word, up, k) + np.bincount(drawn, down.sum(axis=0), k)])
        memory += grad * grad
        values = values + rate * grad / np.sqrt(memory)
    return Model.unflat(values, k)


def _epoch(ngrams: DataFrame, model: Model, noise: np.ndarray, number: int) -> Model:
    """All n-grams once: every task goes through its share, the results are averaged by their n-grams."""
    k = len(noise)

    def run(batches):
        total, state, memory, rng = 0, model, np.full(len(model.flat()), 1e-8), None
        for batch in batches:
            codes, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(codes):
                rng = rng or np.random.default_rng([number, int(codes[0])])
                state = nce_steps(state, memory, codes, counts, noise, rng, RATE)
                total += int(counts.sum())
        if total:
            values = np.append(state.flat() * total, total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["at", "v"])

    parts = ngrams.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    values = parts.sort_values("at")["v"].to_numpy()
    return Model.unflat(values[:-1] / values[-1], k) if len(values) else model


@dataclass
class Trained:
    model: Model
    classes: Classes
    #: Natural log of the count mass of each class, N + 0.5 * (V + 1) over its words.
    masses: np.ndarray
    #: Words from this count on are in the head.
    least: int
    tokens: int
    distinct: int
    vocabulary: DataFrame


def _least_count(vocabulary: DataFrame) -> int:
    """The least count from which on there are at most HEAD words, to within an eighth."""
    # Small counts are steps of their own, large ones an eighth of their size wide: a few hundred steps.
    step = F.when(F.col("c") < 64, F.col("c")).otherwise(F.floor(F.log2(F.col("c") / 64.0) * 8) + 64).cast("bigint")
    least = words = 0
    for row in vocabulary.groupBy(step.alias("step")).agg(
            F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect():
        words += row.n
        if words > HEAD:
            return least or row.c + 2**62
        least = row.c
    return least


def train(texts: DataFrame, column: str = "text", shortlist: int = SHORTLIST, spellings: int = SPELLINGS,
          epochs: int = EPOCHS) -> Trained:
    """Fit on all rows of `texts`."""
    spark = texts.sparkSession
    body = texts.select(text_of(column).cast("binary").alias("body"))
    path = scratch_path(spark, "lm-words")
    body.mapInArrow(_count_words, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")).write.parquet(path)
    vocabulary = spark.read.parquet(path)
    totals = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    least = _least_count(vocabulary)
    head = sorted(((bytes(r.word), r.c) for r in vocabulary.where(F.col("c") >= least).collect()), key=lambda w: (-w[1], w[0]))
    classes = Classes(head, shortlist, spellings)
    k, own = classes.count, classes.shortlist

    # Mass of each class: its own words' counts, and half a count for each of them and one unknown.
    rest = vocabulary if not own else vocabulary.where(
        (F.col("c") < head[own - 1][1]) | ((F.col("c") == head[own - 1][1]) & (F.col("word") > F.lit(head[own - 1][0]))))
    spelled = rest.groupBy((F.crc32(F.expr(f"substring(word, greatest(length(word) - {ENDING - 1}, 1), {ENDING})"))
                            % spellings).alias("at")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    counts, sizes = np.zeros(k), np.zeros(k)
    counts[:own] = classes.counts[:own]
    sizes[:own] = 1
    for row in spelled.collect():
        counts[own + row.at], sizes[own + row.at] = row.c, row.v
    masses = counts + 0.5 * sizes
    masses[own:] += 0.5
    noise = (counts + 0.5) / (counts + 0.5).sum()
    model = Model.start(noise)
    if totals.n:
        grams = scratch_path(spark, "lm-ngrams")
        body.mapInArrow(_count_ngrams(classes), "code bigint, c bigint").groupBy("code").agg(
            F.sum("c").alias("c")).write.parquet(grams)
        ngrams = spark.read.parquet(grams)
        for number in range(epochs):
            model = _epoch(ngrams, model, noise, number)
    return Trained(model, classes, np.log(masses), least, int(totals.n), int(totals.v), vocabulary)


def _score_texts(trained: Trained, carried: int, names: list[str]):
    """What the head and the model know of each text, and its other words with their counts.

    `base` and `lm` are natural logs; a rare word counts as unknown until its count is joined.
    """
    classes, model, masses = trained.classes, trained.model, trained.masses
    k, unknown = classes.count, float(np.log(0.5))
    logs = np.log(classes.counts + 0.5)
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        by_one, by_two, norms = (table.ravel() for table in model.tables())

        def of_classes(codes, ids):
            """Log probability of each token's class in its context."""
            two, one = codes // (k + 1), codes % (k + 1)
            return by_one[one * k + ids] + by_two[two * k + ids] - norms[codes]

        def score(bodies):
            """Scores of some texts, TOKENS at a time."""
            n = len(bodies)
            tokens, known, base, lm, tails = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), [
                Counter() for _ in bodies]
            held, held_n = [], 0

            def settle_held():
                owner = np.concatenate([np.full(len(ids), t) for t, ids, _, _ in held])
                ids, places, codes = (np.concatenate([h[j] for h in held]) for j in (1, 2, 3))
                inside = np.where(places >= 0, logs[places] if len(logs) else 0.0, unknown)
                base[:] += np.bincount(owner, inside, n)
                lm[:] += np.bincount(owner, inside - masses[ids] + of_classes(codes, ids), n)
                tokens[:] += np.bincount(owner, minlength=n)
                known[:] += np.bincount(owner, places >= 0, n).astype(np.int64)

            for t, body in enumerate(bodies):
                before = (k, k)
                for words in token_lists(body or b""):
                    places, ids = classes(words)
                    if not len(ids):
                        continue
                    two, one = contexts(ids, before)
                    held.append((t, ids, places, two * (k + 1) + one))
                    before = tuple([*before, *ids[-2:].tolist()][-2:])
                    tails[t].update([words[j] for j in np.nonzero(places < 0)[0].tolist()])
                    held_n += len(ids)
                    if held_n > TOKENS:
                        settle_held()
                        held, held_n = [], 0
            if held:
                settle_held()
            return tokens, known, base, lm, tails

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                tokens, known, base, lm, tails = score(part.column(carried).to_pylist())
                rows = pa.array(row + np.arange(part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(j) for j in range(carried)], rows, pa.array(tokens), pa.array(known),
                     pa.array(base), pa.array(lm),
                     pa.array([[{"word": w, "n": c} for w, c in tail.items()] for tail in tails], tail_type)], names=names)

    return run


def score(df: DataFrame, trained: Trained, column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) and n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = df.sparkSession
    carried = [c for c in (df.columns if carry is None else carry) if c not in RESULTS]
    fields = [T.StructField(f"c{j}", df.schema[c].dataType) for j, c in enumerate(carried)]
    schema = T.StructType([*fields, *T.StructType.fromDDL(
        "row bigint, n_tokens bigint, head_known bigint, base double, lm double, "
        "tail array<struct<word:binary,n:bigint>>").fields])
    path = scratch_path(spark, "lm-scores")
    df.select(*[col(c).alias(f"c{j}") for j, c in enumerate(carried)], text_of(column).cast("binary").alias("body")).mapInArrow(
        _score_texts(trained, len(carried), schema.names), schema).write.parquet(path)
    scored = spark.read.parquet(path)

    # Rare words meet their counts: what each adds to the half count it was given as an unknown word.
    rare = trained.vocabulary.where(F.col("c") < trained.least)
    words = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    added = words.join(rare, "word").groupBy("row").agg(
        F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log((F.col("c") + 0.5) / 0.5)).alias("gain"))
    whole = trained.tokens + 0.5 * (trained.distinct + 1)
    gain = F.coalesce("gain", F.lit(0.0))
    return scored.drop("tail").join(added, "row", "left").select(
        *[F.col(f"c{j}").alias(c) for j, c in enumerate(carried)], "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(trained.tokens).cast("bigint").alias("train_tokens"),
        ((F.col("base") + gain - F.col("n_tokens") * float(np.log(whole))) / LN10).alias("base_score"),
        ((F.col("lm") + gain) / LN10).alias("score"))
