"""Repair of damaged conversations by generalised LR parsing with weighted edits.

The rows of a conversation are taken by turn (nulls first), rows of one turn by role and then by a
digest of the text. A row's first fault counts: blank, duplicate (role and text seen earlier),
truncated (the last character is no end of a sentence). `turn_grammar` finds the cheapest edits.

How it runs: equal rows are counted before anything is ordered, duplicates follow from a grouped
minimum, and the ordered rows are cut into blocks of at most BLOCK_ROWS rows of one conversation. For
each block a task finds the cheapest way from every stack that may stand before it to every stack
after it; the ways of a conversation's blocks are then chained. So no task holds a long conversation's
rows; chaining sees one small table a block. The audit and the repaired digest of a conversation are single
values by their nature: a conversation's edits, one letter each, come together in one row.

Defined results: null role, text, turn or id count as one space where a string is made of them, so
a null text is blank. A null turn has no part in gaps. An empty role has a space as its initial, which no
grammar rule takes. Conversations without rows left have zeros, an empty audit and the empty text.
Repeated rows are duplicates. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weighyard.llm.common import col, settle
from weighyard.llm.turn_grammar import INSERT, PLACE, ROOT, TOPS, Row, best_end, offer, step

#: Rows of one conversation in a block.
BLOCK_ROWS = 2048
#: White space and the ends of sentences.
BLANKS = "\\u0020\\u0009\\u000A\\u000B\\u000C\\u000D"
LEGAL_PAIRS = ("su", "ua", "au")

#: The place of inserts at the end of a conversation, behind all blocks.
LAST_BLOCK = 2**31 - 1

_ORDER = ("conv_id", "turn", "role", "digest")


def turns(df: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """The four columns the operator works on, under its names, with one space for a null role or text."""
    return df.select(col(conv).alias("conv_id"), col(turn).alias("turn"),
                     *[F.coalesce(col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])


def damage(rows: DataFrame) -> DataFrame:
    """Test damage of `turns` rows by crc32(conv_id:turn) % 20: drop, empty, cut, repeat, rerole."""
    def part(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    return rows.withColumn("_kind", kind).where("_kind <> 0").select(
        "conv_id", "turn", F.expr("IF(_kind = 4, 'user', role)").alias("role"),
        F.expr("CASE _kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END").alias("text"),
        F.expr("IF(_kind = 3, 2L, 1L)").alias("copies"))


def _facts(counted: DataFrame) -> DataFrame:
    """Narrow rows: order columns, copies, the role's initial and the faults."""
    narrow = settle(counted.select(
        "conv_id", "turn", "role", "digest", "copies",
        F.expr("IF(role = '', ' ', substring(role, 1, 1))").alias("initial"),
        F.expr(f"trim(BOTH '{BLANKS}' FROM text) = ''").alias("blank"),
        F.expr(f"substring(trim(TRAILING '{BLANKS}' FROM text), -1) NOT IN ('.', '!', '?')").alias("truncated")))
    first = narrow.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    first = first.toDF("first_conv", "first_role", "first_digest", "first")
    return narrow.join(first, (F.col("conv_id").eqNullSafe(F.col("first_conv"))) & (
        F.col("role") == F.col("first_role")) & (F.col("digest") == F.col("first_digest"))).select(
        "conv_id", "turn", "role", "digest", "copies", "initial", "blank",
        F.expr("NOT (turn <=> first.turn)").alias("again"), "truncated")


def _in_order(batches, names, types):
    """Rows as tuples; `types` learns the Arrow types of the columns."""
    for batch in batches:
        types.update({field.name: field.type for field in batch.schema})
        yield from zip(*[batch.column(name).to_pylist() for name in names])


def _blocks(rows, most):
    """Rows of one conversation, at most `most` at a time: (whether they are its first, rows)."""
    held, opening = [], False
    for row in rows:
        changed = bool(held) and row[0] != held[0][0]
        if changed or len(held) == most:
            yield opening, held
            held, opening = [], changed
        held.append(row)
    if held:
        yield opening, held


def _batch(rows: list, types: list, names: list[str]):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


_WAYS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()),
                            ("audit", pa.string()), ("roles", pa.string())]))
_KEPT = pa.list_(pa.struct([("edit", pa.int64()), ("action", pa.string()), ("given", pa.string()), ("at", pa.int64())]))


def _transfers(names: list[str], block_rows: int):
    """Rows with their block and place; the last row of a block carries the block's ways."""
    from pyspark import TaskContext

    def run(batches):
        types, out, weight = {}, [], 0
        part = TaskContext.get().partitionId()
        rows = _in_order(batches, (*_ORDER, "copies", "initial", "blank", "again", "truncated"), types)

        def flush():
            return _batch(out, [types["conv_id"], types["turn"], pa.string(), pa.string(), pa.int32(), pa.int32(),
                                pa.int64(), _WAYS, pa.int64(), pa.string(), pa.string()], names)

        for number, (opening, block) in enumerate(_blocks(rows, block_rows)):
            # A conversation that starts within this partition starts with the empty stack; others go on from any.
            ways = {top: {top: (0, "", "")} for top in ([ROOT] if opening else TOPS)}
            at, illegal, before = 0, 0, None
            for conv, turn, role, digest, copies, initial, blank, again, truncated in block:
                row = Row(initial, blank or again, truncated, copies)
                ways = {begin: step(frontier, row) for begin, frontier in ways.items()}
                illegal += (before is not None and before + initial not in LEGAL_PAIRS) + copies - 1
                before = initial
                out.append([conv, turn, role, digest, part, number, at, None, None, None, None])
                at += copies
            table = [{"begin": PLACE[begin], "end": PLACE[end], "cost": way[0], "audit": way[1], "roles": way[2]}
                     for begin, frontier in ways.items() for end, way in frontier.items()]
            out[-1][7:] = [table, illegal, block[0][5], before]
            weight += len(block) + sum(len(way["audit"]) for way in table) // 16
            if weight > 8192:
                yield flush()
                out, weight = [], 0
        if out:
            yield flush()

    return run


def _ranked(frontier: dict) -> dict:
    """The frontier with the rank of its audits in place of the audits.

    Ways over the same rows of whole blocks end with an edit of a row, so of two different audits
    none begins the other, and ranks order whatever follows them.
    """
    ranks = {key: k for k, key in enumerate(sorted({way[1] for way in frontier.values()}))}
    return {top: (way[0], ranks[way[1]], way[2]) for top, way in frontier.items()}


def _kept(audit: str, roles: str) -> list[dict]:
    """The edits that leave a row: their place, their role, and the number of rows before (none for inserts)."""
    out, inserted = [], 0
    for found in re.finditer("[KRI]", audit):
        edit, action = found.start(), found.group()
        new = action == INSERT
        out.append({"edit": edit, "action": action, "given": roles[edit], "at": None if new else edit - inserted})
        inserted += new
    return out


def _chain(names: list[str]):
    """The chosen way through the blocks of each conversation: one row a block and one for the end."""
    def chosen(own, frontier, illegal):
        ends = []
        for top, (cost, rank, way) in frontier.items():
            more, audit, roles = best_end({top: (0, "", "")})[1]
            ends.append((cost + more, rank, audit, roles, way))
        cost, _, audit, roles, way = min(ends, key=lambda end: end[:3])
        rows = [[own, way[1], LAST_BLOCK, audit, _kept(audit, roles), cost, illegal]]
        while way is not None:
            way, part, block, letters, given = way
            rows.append([own, part, block, letters, _kept(letters, given), None, None])
        return rows

    def run(batches):
        types, out, weight = {}, [], 0
        own, frontier, illegal, before = None, None, 0, None

        def flush():
            return _batch(out, [types["conv_id"], pa.int32(), pa.int32(), pa.string(), _KEPT, pa.int64(), pa.int64()], names)

        for conv, part, block, table, inside, first, last in _in_order(
                batches, ("conv_id", "part", "block", "ways", "illegal", "first_initial", "last_initial"), types):
            if frontier is None or conv != own:
                if frontier is not None:
                    out += chosen(own, frontier, illegal)
                if weight > 65536:
                    yield flush()
                    out, weight = [], 0
                own, frontier, illegal, before = conv, {ROOT: (0, 0, None)}, 0, None
            illegal += inside + (before is not None and before + first not in LEGAL_PAIRS)
            before, after = last, {}
            for way in table:
                old = frontier.get(TOPS[way["begin"]])
                if old is not None:
                    offer(after, TOPS[way["end"]], (old[0] + way["cost"], (old[1], way["audit"]),
                                                    (old[2], part, block, way["audit"], way["roles"])))
            frontier = _ranked(after)
            weight += len(table[0]["audit"])
        if frontier is not None:
            out += chosen(own, frontier, illegal)
            yield flush()

    return run


def _faults(facts: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of the conversations that have rows."""
    by_turn = facts.groupBy("conv_id", "turn").agg(
        F.expr("sum(IF(blank, copies, 0))").alias("blank"),
        F.expr("sum(IF(blank, 0, copies - IF(again, 0, 1)))").alias("duplicate"),
        F.expr("count_if(NOT blank AND NOT again AND truncated)").alias("truncated"))
    span = "CAST(max(turn) AS DECIMAL(38,0)) - CAST(min(turn) AS DECIMAL(38,0)) + 1 - count(turn)"
    return by_turn.groupBy("conv_id").agg(
        F.expr(f"coalesce(try_cast({span} AS BIGINT), 0L)").alias("gaps"),
        *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")])


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(repaired rows, report) of rows (conv_id, turn, role, text and perhaps copies) as `turns` makes them.

    Repaired rows: conv_id, part, block, edit (their order), turn, role, text, action (K, R or I). The
    report has one row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum(copies).cast("bigint").alias("copies"))
    counted = settle(counted.withColumn("digest", F.sha2("text", 256)))
    facts = settle(_facts(counted))
    id_field, turn_field = facts.schema["conv_id"], facts.schema["turn"]
    placed_schema = T.StructType([id_field, turn_field, *T.StructType.fromDDL(
        "role string, digest string, part int, block int, at bigint, "
        "ways array<struct<begin:int,end:int,cost:bigint,audit:string,roles:string>>, "
        "illegal bigint, first_initial string, last_initial string").fields])
    ordered = facts.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    placed = settle(ordered.mapInArrow(_transfers(placed_schema.names, block_rows), placed_schema))

    chain_schema = T.StructType([id_field, *T.StructType.fromDDL(
        "part int, block int, audit string, kept array<struct<edit:bigint,action:string,given:string,at:bigint>>, "
        "cost bigint, illegal bigint").fields])
    blocks = placed.where("ways IS NOT NULL").select(
        "conv_id", "part", "block", "ways", "illegal", "first_initial", "last_initial")
    chained = settle(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(
        _chain(chain_schema.names), chain_schema))

    report = chained.groupBy(F.col("conv_id").alias("_own")).agg(
        F.max("illegal").alias("illegal"), F.max("cost").alias("cost"),
        F.expr("array_join(transform(array_sort(collect_list(struct(part, block, audit))), b -> b.audit), '')").alias("audit"))
    report = _faults(facts).join(report, F.col("conv_id").eqNullSafe(F.col("_own"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return _repaired(chained, placed, counted), report


def _repaired(chained: DataFrame, placed: DataFrame, counted: DataFrame) -> DataFrame:
    """The rows that the chosen edits leave, with their texts."""
    edits = chained.selectExpr("conv_id", "part", "block", "inline(kept)")
    own = edits.where("action <> 'I'").drop("conv_id").join(
        placed.select("conv_id", "turn", "role", "digest", "part", "block", "at"), ["part", "block", "at"])
    texts = counted.select(*[F.col(n).alias(f"_{n}") for n in _ORDER], "text")
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in _ORDER]
    given = "CASE given WHEN 'u' THEN 'user' ELSE 'assistant' END"
    columns = ["conv_id", "part", "block", "edit", "turn"]
    kept = own.join(texts, same[0] & same[1] & same[2] & same[3]).select(
        *columns, F.expr(f"IF(action = 'K', role, {given})").alias("role"), "text", "action")
    new = edits.where("action = 'I'").withColumn("turn", F.lit(None).cast(counted.schema["turn"].dataType)).select(
        *columns, F.expr(given).alias("role"), F.lit("").alias("text"), "action")
    return kept.union(new)


def repaired_digest(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of `role:text`, joined by newlines, in order."""
    lines = F.expr("transform(array_sort(collect_list(struct(part, block, edit, concat(role, ':', text) AS line))), x -> x.line)")
    return repaired.groupBy("conv_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


def repair_report(rows: DataFrame, everyone: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The report with digests, one row for each conv_id of `everyone`, also those without rows left."""
    repaired, report = repair(rows, block_rows)
    ids = everyone.select("conv_id").distinct()
    reported = report.withColumnRenamed("conv_id", "_reported")
    digests = repaired_digest(repaired).withColumnRenamed("conv_id", "_digested")
    zeros = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in
             ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(reported, F.col("conv_id").eqNullSafe(F.col("_reported")), "left").join(
        digests, F.col("conv_id").eqNullSafe(F.col("_digested")), "left").select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
