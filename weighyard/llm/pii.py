"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) are the matches of four fixed patterns that pass their
check. The method looks for further spans among candidates (a word with figures after a
keyword, an address spelt out, a national number, an account number): labelers of three sorts
vote for or against each candidate, or abstain:

- regex labelers look at the candidate's own form,
- gazetteer labelers look it up among domain endings, country codes and placeholder words,
- context labelers look at the words before it.

Votes are counted by pattern of votes, a table of at most 3^labelers rows whatever the
corpus. Expectation-maximisation over it estimates how often each labeler is right on true and
on false spans and, with it, the probability of every pattern. The final span classifier is a
logistic regression fitted to these probabilities; it sees features of the span (its kind, share
of digits, length, mixed case, separators, context), also bounded in number, and so decides on
spans where labelers abstain. Both fits read pattern counts only.

Positions count code points, ends are exclusive. Candidates that overlap a base span are
dropped: base spans stay as they are.

Cases: null text is the empty text and has no spans; null ids and repeated rows are carried; no
join is made, so equal rows cannot multiply. An empty table gives an empty result and a model of
prior values. `redact` keeps all columns; other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighyard.llm.common import col, original

# --- fixed values: the base patterns, in the order of the kinds ------------------------------
# A match starts at the search start or where its first run of characters starts, and runs are
# possessive: the same matches as the plain patterns, in linear time.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
HINTS = {"email": "contains({0}, '@')", "ip": "{0} RLIKE '[0-9][.][0-9]'",
         "card": "{0} RLIKE '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", "phone": "contains({0}, '+')"}
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# --- fixed values: candidates of the method ----------------------------------------------------
CANDIDATE_PATTERNS = {
    "account": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "address": r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63} ?"
               r"(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,24}\b",
    "national": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api_?key)\b\s{0,3}[=:]\s{0,3}[\x22']?[A-Za-z0-9+/_-]{8,128}",
}
CANDIDATE_HINT = (r"(?i)[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|[\[( ]at[\]) ]|[0-9]{3}-[0-9]{2}-[0-9]{4}"
                  r"|(?:token|secret|passw(?:or)?d|key)\s{0,3}[=:]")
COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE"
ENDINGS = "com|net|org|edu|gov|io|de|fr|es|it|uk|nl|ch|at|be|eu"
PLACEHOLDERS = "example|sample|test|dummy|changeme|xxxx|0000|1234"
KEYWORDS = "iban|account|konto|compte|cuenta|ssn|social|mail|contact|token|secret|password|passwd|key"


def quoted(pattern: str) -> str:
    """The pattern as a raw SQL literal."""
    return 'r"' + pattern.replace('"', r"\x22") + '"'


def like(value: str, pattern: str) -> str:
    return f"{value} RLIKE {quoted(pattern)}"


#: Labelers: +1 for a span, -1 against it, 0 abstains. `s` is the candidate.
LABELERS = {
    "regex_form": f"""CASE s.kind WHEN 'account' THEN if({like('s.body', '^[A-Z]{2}[0-9]{2}([ ]?[0-9]{2,4}){2}')}, 1, -1)
        WHEN 'national' THEN if({like('s.body', '^(000|666|9[0-9]{2})|-00-|-0000$')}, -1, 1)
        WHEN 'secret' THEN if({like('s.body', '[=:].*[0-9]')} AND {like('s.body', '[=:].*[A-Za-z]')}, 1, -1)
        ELSE if({like('s.body', r'[\[(]')}, 1, 0) END""",
    "regex_digits": "CASE WHEN s.digits >= 12 THEN 1 WHEN s.digits = 0 AND s.kind <> 'address' THEN -1 ELSE 0 END",
    "gazetteer_known": f"""CASE WHEN s.kind = 'account' THEN if({like('s.body', f'^({COUNTRIES})')}, 1, -1)
        WHEN s.kind = 'address' THEN if({like('s.body', f'(?i)({ENDINGS})$')}, 1, -1) ELSE 0 END""",
    "gazetteer_placeholder": f"if({like('s.body', f'(?i){PLACEHOLDERS}')}, -1, 0)",
    "context_keyword": f"CASE WHEN {like('s.before', f'(?i)({KEYWORDS})')} OR s.kind = 'secret' THEN 1 ELSE 0 END",
    "context_joined": f"if({like('s.before', '[A-Za-z0-9_]$')}, -1, 0)",
}
FEATURES = {
    **{f"kind_{kind}": f"s.kind = '{kind}'" for kind in CANDIDATE_PATTERNS},
    "many_digits": "s.digits * 2 >= length(s.body)",
    "some_digits": "s.digits > 0",
    "long": "length(s.body) >= 24",
    "mixed": f"{like('s.body', '[a-z]')} AND {like('s.body', '[A-Z]')}",
    "separated": like("s.body", "[ -]"),
    "keyword": like("s.before", f"(?i)({KEYWORDS})"),
    "placeholder": like("s.body", f"(?i){PLACEHOLDERS}"),
}
_BLOCK = 128


def spans_sql(text: str, pattern: str, hint: str) -> str:
    """SQL for the array of (body, start) of all matches.

    Matches and the pieces between them come from the same pattern, so starts are sums of
    lengths. Sums run over blocks of block sums, which keeps a text full of matches from
    taking the square of their number.
    """
    literal = quoted(pattern)
    upto = lambda source, n: f"aggregate(slice({source}, 1, {n}), 0, (a, x) -> a + x)"
    return f"""CASE WHEN {hint.format(text)} THEN element_at(transform(array(struct(
        regexp_extract_all({text}, {literal}, 0) AS found, split({text}, {literal}, -1) AS between)), p ->
      element_at(transform(array(struct(p.found AS found, p.between AS between,
        transform(p.found, (m, i) -> length(m) + length(p.between[i])) AS steps)), q ->
      element_at(transform(array(struct(q.found AS found, q.between AS between, q.steps AS steps,
        transform(sequence(0, size(q.steps) div {_BLOCK}), b -> aggregate(
            slice(q.steps, b * {_BLOCK} + 1, {_BLOCK}), 0, (a, x) -> a + x)) AS blocks)), r ->
      transform(r.found, (m, i) -> struct(m AS body, {upto('r.blocks', f'i div {_BLOCK}')}
        + aggregate(slice(r.steps, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}), 0, (a, x) -> a + x)
        + length(r.between[i]) AS start))), 1)), 1)), 1)
      ELSE CAST(array() AS ARRAY<STRUCT<body: STRING, start: INT>>) END"""


def luhn_sql(digits: str) -> str:
    """Whether a string of digits passes the Luhn check."""
    return f"""aggregate(sequence(1, length({digits})), 0, (a, i) -> a + element_at(
        if(i % 2 = 0, array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9)),
        CAST(substr({digits}, length({digits}) + 1 - i, 1) AS INT) + 1)) % 10 = 0"""


_DIGITS = "regexp_replace(m.body, '[^0-9]', '')"
CHECKS = {
    "email": "true",
    "ip": f"m.body RLIKE r'^{BYTE}[.]{BYTE}[.]{BYTE}[.]{BYTE}$'",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {luhn_sql(_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def _base_sql(text: str) -> str:
    parts = [f"""transform(filter({spans_sql(text, pattern, HINTS[kind])}, m -> {CHECKS[kind]}),
        m -> struct('{kind}' AS kind, m.start AS start, m.start + length(m.body) AS end))"""
             for kind, pattern in BASE_PATTERNS.items()]
    return f"concat({', '.join(parts)})"


def _candidate_sql(text: str) -> str:
    parts = [f"""transform({spans_sql(text, pattern, 'true')}, m -> struct('{kind}' AS kind, m.start AS start,
        m.start + length(m.body) AS end, m.body AS body,
        substr({text}, greatest(1, m.start - 23), least(24, m.start)) AS before,
        length(regexp_replace(m.body, '[^0-9]', '')) AS digits))""" for kind, pattern in CANDIDATE_PATTERNS.items()]
    kind = "STRUCT<kind: STRING, start: INT, end: INT, body: STRING, before: STRING, digits: INT>"
    return f"""CASE WHEN {text} RLIKE {quoted(CANDIDATE_HINT)} THEN filter(concat({', '.join(parts)}), s ->
        NOT exists(base, b -> b.start < s.end AND s.start < b.end))
        ELSE CAST(array() AS ARRAY<{kind}>) END"""


@dataclass
class SpanModel:
    """Reliabilities per labeler, (rate on true spans, rate on false spans) of its votes, and the classifier."""

    prior: float
    reliability: dict[str, dict[int, tuple[float, float]]]
    weights: dict[str, float]
    threshold: float = 0.5


def expectation_maximisation(patterns: dict[tuple, float], labelers: list[str], rounds=50):
    """Prior, vote rates and probability per vote pattern from counted patterns.

    Starts from majority votes; rates carry a pseudo-count so that few votes prove little.
    """
    chance = {p: 0.5 + 0.45 * math.tanh(sum(p)) for p in patterns}
    prior, rates = 0.5, {}
    for _ in range(rounds if patterns else 1):
        total = sum(patterns.values())
        true = sum(n * chance[p] for p, n in patterns.items())
        prior = (true + 1) / (total + 2)
        for at, name in enumerate(labelers):
            rates[name] = {}
            for vote in (-1, 0, 1):
                yes = sum(n * chance[p] for p, n in patterns.items() if p[at] == vote)
                no = sum(n * (1 - chance[p]) for p, n in patterns.items() if p[at] == vote)
                lean = {-1: (1, 2), 0: (2, 2), 1: (2, 1)}[vote]  # a labeler is rather right than wrong
                rates[name][vote] = ((yes + lean[0]) / (true + 5), (no + lean[1]) / (total - true + 5))
        for p in patterns:
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(rates[name][vote][0] / rates[name][vote][1]) for name, vote in zip(labelers, p, strict=True))
            chance[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, rates, chance


def fit_logistic(rows: list[tuple[tuple, float, float]], names: list[str], rounds=400, rate=0.5, ridge=1e-3):
    """Weights (with 'bias') of a logistic regression on (features, target probability, count)."""
    weights, total = [0.0] * (len(names) + 1), sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        slope = [ridge * w for w in weights]
        for features, target, n in rows:
            x = (*features, 1)
            z = sum(w * v for w, v in zip(weights, x, strict=True))
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - target) * n / total
            for i, v in enumerate(x):
                slope[i] += error * v
        weights = [w - rate * g for w, g in zip(weights, slope, strict=True)]
    return dict(zip([*names, "bias"], weights, strict=True))


def with_spans(docs: DataFrame, text="text") -> DataFrame:
    """The documents with `base` and `candidates` (arrays of spans) beside a clean `body`."""
    rows = docs.withColumn("body", F.coalesce(col(text).cast("string"), F.lit("")))
    return rows.withColumn("base", F.expr(_base_sql("body"))).withColumn(
        "candidates", F.expr(_candidate_sql("body")))


def fit(docs: DataFrame, text="text") -> SpanModel:
    """Reliabilities and classifier from the votes on all candidates of the documents."""
    spans = with_spans(docs.select(col(text).alias("text"))).where("size(candidates) > 0").select(
        F.explode("candidates").alias("s"))
    counted = spans.selectExpr(
        *[f"CAST({vote} AS INT) AS v_{name}" for name, vote in LABELERS.items()],
        *[f"CAST({test} AS INT) AS f_{name}" for name, test in FEATURES.items()],
    ).groupBy(*[f"v_{n}" for n in LABELERS], *[f"f_{n}" for n in FEATURES]).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.collect()  # at most 3^labelers times 2^features rows, in practice some dozens
    patterns: dict[tuple, float] = {}
    for row in rows:
        votes = tuple(row[f"v_{n}"] for n in LABELERS)
        patterns[votes] = patterns.get(votes, 0) + row["n"]
    prior, rates, chance = expectation_maximisation(patterns, list(LABELERS))
    seen: dict[tuple, list[float]] = {}
    for row in rows:
        key = tuple(row[f"f_{n}"] for n in FEATURES)
        total = seen.setdefault(key, [0.0, 0.0])
        total[0] += row["n"] * chance[tuple(row[f"v_{n}"] for n in LABELERS)]
        total[1] += row["n"]
    weights = fit_logistic([(key, t / n, n) for key, (t, n) in sorted(seen.items())], list(FEATURES))
    return SpanModel(prior, rates, weights)


def find(docs: DataFrame, model: SpanModel, text="text") -> DataFrame:
    """The documents with `spans` (kind, start, end): base spans, then accepted candidates, each by
    kind as listed and start; `base` holds the base spans alone."""
    odds = " + ".join([f"{model.weights['bias']!r}D", *[
        f"if({test}, {model.weights[name]!r}D, 0D)" for name, test in FEATURES.items()]])
    bar = math.log(model.threshold / (1 - model.threshold))
    accepted = f"""transform(filter(candidates, s -> {odds} > {bar!r}D),
        s -> struct(s.kind AS kind, s.start AS start, s.end AS end))"""
    return with_spans(docs, text).withColumn("spans", F.expr(f"concat(base, {accepted})")).drop("candidates")


def spans_text(column: str) -> str:
    return f"array_join(transform({column}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def find_personal_data(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """Per row: doc_id, counts of the base kinds, and the arrays `base` and `spans`."""
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    return find(rows, fit(rows)).select("doc_id", *[
        F.expr(f"CAST(size(filter(base, s -> s.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}")
        for kind in BASE_PATTERNS], "base", "spans")


def redact(docs: DataFrame, text="text") -> DataFrame:
    """All columns, each span of the text replaced by its kind in brackets.

    Overlapping spans are replaced as one, under the kind of the first.
    """
    columns = docs.columns
    short = {name: f"c{at}" for at, name in enumerate(columns)}
    rows = docs.select(*[col(name).alias(alias) for name, alias in short.items()])
    found = find(rows, fit(docs.select(col(text).alias("text"))), short[text])
    # `covered` of a span: where the spans before it end, as a running maximum over blocks
    top = lambda source, n: f"aggregate(slice({source}, 1, {n}), 0, (a, x) -> greatest(a, x))"
    cleaned = f"""element_at(transform(array(array_sort(transform(spans, s -> struct(s.start, s.end, s.kind)))), o ->
        element_at(transform(array(struct(o AS o, transform(sequence(0, size(o) div {_BLOCK}), b ->
            aggregate(slice(o, b * {_BLOCK} + 1, {_BLOCK}), 0, (a, x) -> greatest(a, x.end))) AS blocks)), k ->
        concat(array_join(transform(transform(k.o, (s, i) -> struct(s.start AS start, s.kind AS kind,
            greatest({top('k.blocks', f'i div {_BLOCK}')}, aggregate(slice(k.o, (i div {_BLOCK}) * {_BLOCK} + 1,
              i % {_BLOCK}), 0, (a, x) -> greatest(a, x.end))) AS covered)), s ->
          if(s.start < s.covered, '', concat(substr(body, s.covered + 1, s.start - s.covered),
            '[', upper(s.kind), ']'))), ''),
          substr(body, 1 + array_max(k.blocks)))), 1)), 1)"""
    cleaned = F.expr(f"CASE WHEN size(spans) = 0 THEN {short[text]} ELSE {cleaned} END")
    done = found.withColumn(short[text], cleaned)
    return original(done.select(*[F.col(alias).alias(name) for name, alias in short.items()]), columns)
