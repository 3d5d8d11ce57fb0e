"""Language ID by Bayesian evidence fusion.

Four sources of evidence are added as log-likelihoods per language:

- the text: log-probabilities of its letter trigrams, word borders included, under each language, a table
  of fixed size (`FEATURES` hash buckets per language) counted over all rows with a declared language and
  over all rows without a declaration whose function words name one (`function_word_vote`);
- the declared language: how often a declaration says `a` where the text says `b`;
- the address suffix (the last label of the host): counts by suffix and language;
- the host: counts by host, smoothed towards those of its registered domain, those towards its
  suffix and those towards all rows: (n + strength * parent) / (total + strength).

Text evidence is tempered, because neighbouring words are not independent. Counts of suffixes,
domains and hosts come from grouped aggregation over the language that the text alone gives, so
declarations that are wrong do not feed themselves. A row is rejected when its text has no letters,
when no language explains the text better than chance would, or when the best language stays under
`ACCEPT`.

A wrongly declared text also trains the language it claims, so in a tiny corpus a long text in an
unknown language that is declared as a known one may pass. Declarations outside `LANGUAGES` are no
evidence, and such rows don't train. Only languages with an entry in `FUNCTION_WORDS` are learned
without declarations.

Cases: null or empty text, null declarations, hosts and ids are allowed; such evidence is left out,
and a text without letters is rejected with language 'und'. Repeated rows are judged alike; equal
probabilities go to the first language as listed. An empty table gives an empty result. `keep_known`
carries all columns; `identify` replaces columns that are named like its results.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weighyard.llm.common import col, plain_names, settle, sized, text_of, tidy

LANGUAGES = ("de", "en", "es", "fr")
FEATURES = 1 << 16
TEMPER = 0.2
STRENGTH = 20.0
ACCEPT = 0.5
#: Characters of a text worked on at once; longer texts are summed over pieces.
PIECE = 1 << 20
#: Common function words; words that two of the languages share say nothing and are left out.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ich sich mit auf für ein eine den dem von zu im auch als wie bei oder nach nur wird aus über",
    "en": "the and of to is that it was for with are this be have from by not they you his which were there their has had would",
    "es": "el los las y del por para con una como más pero sus este fue ser son muy también hasta desde está donde cuando todo",
    "fr": "le les et des est du dans pour qui sur pas au avec ce il sont plus nous vous cette mais ou aux ont être leur même",
}
_VOTES = {word: name for name, words in FUNCTION_WORDS.items() for word in words.split()}
#: Function words of a language that a text needs, and their lead over the next language.
LEAST_VOTES, LEAD = 3, 2
RESULTS = ("letters", "probability", "accepted", "lang")


def function_word_vote(text: str) -> str | None:
    """The language whose function words the text holds, if it holds enough and clearly more than of another."""
    votes = dict.fromkeys(FUNCTION_WORDS, 0)
    for word in re.finditer(r"[^\W\d_]+", text.lower()):
        name = _VOTES.get(word[0])
        if name:
            votes[name] += 1
    first, second = sorted(votes.values())[:-3:-1]
    return max(votes, key=votes.get) if first >= LEAST_VOTES and first >= LEAD * second else None


def features(text: str) -> np.ndarray:
    """Hash buckets of all letter trigrams, word borders included; all of the text, in pieces."""
    out = []
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at:at + PIECE + 2].lower().encode("utf-32-le", "replace"), "<u4")
        letter = (codes >= 97) & (codes <= 122) | (codes >= 0xAA) & (codes != 0xD7) & (codes != 0xF7) & (
            (codes < 0x2000) | (codes > 0x2BFF))
        codes = np.where(letter, codes, 32).astype(np.uint64)
        if len(codes) < 3 and at == 0:
            codes = np.concatenate([codes, np.full(3 - len(codes), 32, np.uint64)])
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9))
        out.append((mixed >> np.uint64(40))[(b != 32) & ((a != 32) | (c != 32))] & np.uint64(FEATURES - 1))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def text_model(docs: DataFrame, languages=LANGUAGES) -> np.ndarray:
    """Log-probabilities [bucket, language], from all rows with a declared or a voted language.

    Each task adds its counts into one table of fixed size; the tables are summed by bucket.
    """
    names = list(languages)

    def count(batches):
        table = np.zeros((len(names), FEATURES), np.int64)
        waiting: list[list] = [[] for _ in names]

        def add(at):
            if waiting[at]:
                table[at] += np.bincount(np.concatenate(waiting[at]), minlength=FEATURES)
                waiting[at] = []

        for batch in batches:
            for body, declared in zip(batch["body"].to_pylist(), batch["declared"].to_pylist(), strict=True):
                declared = declared or function_word_vote(body)
                if declared not in names:
                    continue
                at = names.index(declared)
                waiting[at].append(features(body))
                if len(waiting[at]) == 200 or len(waiting[at][-1]) > PIECE:
                    add(at)
        for at in range(len(names)):
            add(at)
        at = np.nonzero(table.any(axis=0))[0]
        yield pa.record_batch([pa.array(at)] + [pa.array(line[at]) for line in table],
                              names=["bucket"] + [f"n{i}" for i in range(len(names))])

    rows = docs.where(F.col("declared").isNull() | F.col("declared").isin(*names, "")).select("body", "declared")
    counted = rows.mapInArrow(tidy(count), "bucket long, " + ", ".join(f"n{i} long" for i in range(len(names)))).groupBy(
        "bucket").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))]).toPandas()
    table = np.full((FEATURES, len(names)), 0.5)
    table[counted["bucket"].to_numpy(np.int64)] += counted[[f"n{i}" for i in range(len(names))]].to_numpy(float)
    return np.log(table / table.sum(axis=0))


def text_evidence(docs: DataFrame, model: np.ndarray, languages=LANGUAGES) -> DataFrame:
    """The rows with `letters` (features seen), `fit` (mean log-probability of one under the best
    language) and `said` (tempered log-likelihood per language) in place of their text."""
    kept = [field for field in docs.schema.fields if field.name != "body"]
    sent = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    found = [T.StructField("letters", T.LongType()), T.StructField("fit", T.DoubleType()),
             T.StructField("said", T.ArrayType(T.DoubleType()))]

    def score(batches):
        for batch in batches:
            seen, fit, said = [], [], []
            for body in batch["body"].to_pylist():
                at = features(body)
                total = sent.value[at].sum(axis=0, dtype=np.float64) if len(at) else np.zeros(len(languages))
                seen.append(len(at))
                fit.append(float(total.max()) / max(1, len(at)))
                said.append((total - total.max()) * TEMPER)
            yield pa.record_batch(
                [batch[f.name] for f in kept] + [pa.array(seen, pa.int64()), pa.array(fit, pa.float64()),
                                                 pa.array(said, pa.list_(pa.float64()))],
                names=[f.name for f in kept] + ["letters", "fit", "said"])

    return docs.mapInArrow(tidy(score), T.StructType(kept + found))


def _log_share(counts: list[str], total: str, parent: list[str]) -> list:
    return [F.expr(f"({n} + {STRENGTH}D * {p}) / ({total} + {STRENGTH}D)") for n, p in zip(counts, parent, strict=True)]


def host_priors(rows: DataFrame, levels=("suffix", "domain", "host"), languages=LANGUAGES) -> DataFrame:
    """(suffix, domain, host, prior): language shares per host, smoothed from level to level.

    `rows` has `told` (the text's language) and the level columns. Counts are grouped at
    host level first; the upper levels sum these counts, never the rows.
    """
    span = range(len(languages))
    counts = [f"n{i}" for i in span]
    base = rows.where("letters > 0 AND host IS NOT NULL").groupBy(*levels).agg(
        *[F.sum(F.when(F.col("told") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in span])
    base = settle(base)
    whole = base.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in counts]).first()
    total = sum(whole) + len(languages)
    shares = [repr((n + 1.0) / total) + "D" for n in whole]
    result = base
    for depth, level in enumerate(levels):
        keys = list(levels[:depth + 1])
        summed = base.groupBy(*keys).agg(*[F.sum(c).alias(f"{level}_{c}") for c in counts])
        whole_level = " + ".join(f"{level}_{c}" for c in counts)
        result = result.join(summed, keys)
        mixed = _log_share([f"{level}_{c}" for c in counts], f"({whole_level})", shares)
        result = result.withColumns({f"{level}_p{i}": e for i, e in enumerate(mixed)})
        shares = [f"{level}_p{i}" for i in span]
    return result.select(*levels, F.array(*[F.col(s) for s in shares]).alias("prior"))


def reliability(rows: DataFrame, languages=LANGUAGES) -> list[list[float]]:
    """[declared][language] log P(declared | language), with one pseudo-count."""
    counts = {(r["declared"], r["told"]): r["n"] for r in rows.where("letters > 0").where(
        F.col("declared").isin(*languages)).groupBy("declared", "told").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = [[counts.get((d, i), 0) + 1.0 + 4.0 * (d == name) for i, name in enumerate(languages)] for d in languages]
    return [[float(np.log(n / sum(row[i] for row in table))) for i, n in enumerate(line)] for line in table]


def identify(docs: DataFrame, languages=LANGUAGES) -> DataFrame:
    """Rows with lang, probability and accepted in place of their evidence.

    `docs` has body (no nulls), declared, suffix, domain, host and any other columns, which are
    carried; texts are read twice and moved nowhere.
    """
    evidence = ("body", "declared", "suffix", "domain", "host")
    carried = plain_names([name for name in docs.columns if name not in (*evidence, *RESULTS)])
    docs = docs.select(*evidence, *[col(name).alias(short) for name, short in carried.items()])
    model = text_model(docs, languages)
    rows = settle(text_evidence(docs, model, languages).withColumn(
        "told", F.expr("CAST(array_position(said, array_max(said)) - 1 AS INT)")))
    priors = settle(host_priors(rows, languages=languages)).select(
        F.col("suffix").alias("s_"), F.col("domain").alias("d_"), F.col("host").alias("h_"), "prior")
    table = reliability(rows, languages)
    declared = "CASE declared " + " ".join(
        f"WHEN '{name}' THEN array({', '.join(repr(v) + 'D' for v in line)})"
        for name, line in zip(languages, table, strict=True)) + " ELSE array_repeat(0D, {}) END".format(len(languages))
    joined = rows.join(sized(priors, 200), (F.col("suffix") == F.col("s_")) & (F.col("domain") == F.col("d_"))
                       & (F.col("host") == F.col("h_")), "left")
    sums = f"""transform({declared}, (d, i) -> said[i] + d + coalesce(ln(prior[i]), 0D))"""
    return joined.withColumn("fused", F.expr(sums)).withColumn(
        "best", F.expr("CAST(array_position(fused, array_max(fused)) AS INT)")).withColumn(
        "probability", F.expr("""if(letters = 0, 0D, 1 / aggregate(fused, 0D,
            (a, x) -> a + exp(x - array_max(fused))))""")).withColumn(
        "accepted", F.expr(f"letters > 0 AND fit > {-math.log(FEATURES)!r}D AND probability >= {ACCEPT}D")).withColumn(
        "lang", F.expr("if(letters = 0, 'und', element_at(array({}), best))".format(
            ", ".join(f"'{n}'" for n in languages)))).select(
        *[F.col(short).alias(name) for name, short in carried.items()], *RESULTS)


def document_evidence(docs: DataFrame, text="text", lang="lang", source="source", doc_id="doc_id") -> DataFrame:
    """Documents as rows of evidence: the source stands for the host."""
    return docs.select(col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"),
                       F.lower(col(lang).cast("string")).alias("declared"), F.lit("").alias("suffix"),
                       F.lit("").alias("domain"), col(source).cast("string").alias("host"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages as rows of evidence: html lang attribute, host levels of the address, visible text."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(
        F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1))
    visible = F.regexp_replace(F.regexp_replace(
        F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&\w+;", " ")
    return pages.select("page_id", visible.alias("body"), declared.alias("declared"), host.alias("at")).select(
        "page_id", "body", "declared", F.regexp_extract("at", r"([^.]+)$", 1).alias("suffix"),
        F.regexp_extract("at", r"([^.]+\.[^.]+)$", 1).alias("domain"), F.when(F.col("at") != "", F.col("at")).alias("host"))


def identify_documents(docs: DataFrame, **columns) -> DataFrame:
    """Per row: doc_id, lang, probability, letters, accepted."""
    return identify(document_evidence(docs, **columns)).select("doc_id", "lang", "probability", "letters", "accepted")


def keep_known(docs: DataFrame, text="text", lang="lang", source="source") -> DataFrame:
    """The rows whose language is accepted, with all columns as they were.

    A row is judged by its own evidence, so the rows take their number along and meet their verdict
    again by it; only rejected numbers are sent, and only where they are few.
    """
    columns = docs.columns
    short = {name: f"c{at}" for at, name in enumerate(columns)}
    rows = docs.select(*[col(name).alias(alias) for name, alias in short.items()]).withColumn(
        "key", F.xxhash64(*[F.coalesce(F.col(short[n]).cast("string"), F.lit("\0")) for n in (text, lang, source)]))
    evidence = rows.select("key", text_of(short[text]).alias("body"), F.lower(F.col(short[lang])).alias("declared"),
                           F.lit("").alias("suffix"), F.lit("").alias("domain"),
                           F.col(short[source]).cast("string").alias("host"))
    rejected = settle(identify(evidence).where("NOT accepted").select("key").distinct())
    kept = rows.join(sized(rejected, 16), "key", "left_anti")
    return kept.select(*[F.col(alias).alias(name) for name, alias in short.items()])
