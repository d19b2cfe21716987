"""Repair of conversations by the cheapest edits, solved once for each distinct signature.

A conversation's signature has one character a row: the initial of its role (``s``, ``u``, ``a``, or ``x`` for others), in
capitals if the text is truncated, or ``d`` for a row that must go, being blank or a duplicate. The cheapest audit of a
signature is found by memoised recursion over its halves, and the audits are joined back to all conversations that have
the signature, whose rows are then replayed.

An audit is the string of the edits' initials: Keep, Rerole, Delete, Insert. It turns the roles into
``(s?(ua)+)?``, and among the cheapest audits the one that is least in ASCII order is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm import _words as W
from lantern.llm._storage import materialise

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What stands before: nothing, the system's row, a user's, an assistant's. The next is a user's but after a user's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ENDS = (NOTHING, ASSISTANT)
#: More inserts at one place lead back to a state that fewer lead to.
_INSERTS = 2
#: Pieces of signatures up to this length are remembered by a worker.
_REMEMBERED = 64
SPACES = " \t\n\x0b\x0c\r"

Best = tuple[tuple[tuple[int, str] | None, ...], ...]


def _row(symbol: str, before: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, state after) of what may be done with one row."""
    yield "D", DELETE, before
    if symbol != "d":
        extra = TRUNCATED if symbol.isupper() else 0
        yield "R", REROLE + extra, _NEXT[before]
        role = symbol.lower()
        if role == "s" and before == NOTHING:
            yield "K", extra, SYSTEM
        elif role == "ua"[_NEXT[before] == ASSISTANT]:
            yield "K", extra, _NEXT[before]


def _least(options: Iterator[tuple[int, int, str]]) -> tuple[tuple[int, str] | None, ...]:
    best: list[tuple[int, str] | None] = [None] * 4
    for state, cost, audit in options:
        if best[state] is None or (cost, audit) < best[state]:
            best[state] = (cost, audit)
    return tuple(best)


def _one(symbol: str) -> Best:
    def options(state: int) -> Iterator[tuple[int, int, str]]:
        for n in range(_INSERTS + 1):
            for edit, cost, after in _row(symbol, state):
                yield after, n * INSERT + cost, "I" * n + edit
            state = _NEXT[state]

    return tuple(_least(options(a)) for a in range(4))


def _joined(left: Best, right: Best) -> Best:
    """Of two audits with one cost between the same states neither begins the other, so the least parts make the least whole."""
    return tuple(_least((c, x[0] + y[0], x[1] + y[1]) for b, x in enumerate(row) if x for c, y in enumerate(right[b]) if y) for row in left)


def _between(signature: str) -> Best:
    """The cheapest audits from each state to each other one."""
    return _remembered(signature) if len(signature) <= _REMEMBERED else _split(signature)


def _split(signature: str) -> Best:
    if len(signature) == 1:
        return _one(signature)
    half = 1 << (len(signature) - 1).bit_length() - 1  # pieces of one size are shared by many signatures
    return _joined(_between(signature[:half]), _between(signature[half:]))


_remembered = lru_cache(maxsize=50_000)(_split)


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; ties go to the audit that is least in ASCII order."""
    starts = _between(signature)[NOTHING] if signature else ((0, ""), None, None, None)
    options = []
    for state, found in enumerate(starts):
        for n in range(_INSERTS + 1):
            if found and state in _ENDS:
                options.append((found[0] + n * INSERT, found[1] + "I" * n))
            state = _NEXT[state]
    return min(options)


def script(signature: str, audit: str) -> list[tuple[str, int, str | None]]:
    """(edit, row from 1 or 0, role it gets) of each step; the states leave one role for every edit but Keep and Delete."""
    steps, state, row = [], NOTHING, 0
    for edit in audit:
        row += edit != "I"
        if edit == "D":
            steps.append((edit, row, None))
            continue
        state = SYSTEM if edit == "K" and state == NOTHING and signature[row - 1] in "sS" else _NEXT[state]
        steps.append((edit, 0 if edit == "I" else row, None if edit == "K" else "user" if state == USER else "assistant"))
    return steps


def faults(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Written rows (conversation, row, turn, role, text, fault, symbol, new_turn, illegal) in order of turns.

    Nulls of role and text are one space. Rows go by turn, nulls first, ties by role and text; ``row`` counts from 1.
    ``fault`` is the first that holds: blank, duplicate (role and text stand in an earlier row), truncated (the last
    character but white space isn't one of ``.!?``); else null. ``illegal``: the initials of the row before and of this one
    are not su, ua or au.

    Two shuffles: by conversation, role and text, then by conversation; windows spill and hold no group in memory.
    """
    own = rows.select(rows[conversation].alias("conversation"), rows[turn].alias("turn"), F.coalesce(rows[role].cast("string"), F.lit(" ")).alias("role"), F.coalesce(rows[text].cast("string"), F.lit(" ")).alias("text"))
    seen = F.row_number().over(Window.partitionBy("conversation", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(last == "", "blank").when(F.col("_seen"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    order = Window.partitionBy("conversation").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.lag(initial).over(order)
    new = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))
    marked = own.withColumn("_seen", seen).withColumn("fault", fault).withColumn("symbol", symbol)
    illegal = before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")
    return materialise(marked.select("conversation", F.row_number().over(order).alias("row"), "turn", "role", "text", "fault", "symbol", new.alias("new_turn"), illegal.alias("illegal")), "faults")


def signatures(marked: DataFrame) -> DataFrame:
    """One written row per conversation: signature, gaps and counts of faults. A conversation's signature is one value."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    of = lambda x: count(F.col("fault").eqNullSafe(F.lit(x)))
    ordered = F.array_sort(F.collect_list(F.struct("row", "symbol")))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum(F.col("new_turn").cast("long")), F.lit(0))
    return materialise(marked.groupBy("conversation").agg(F.array_join(F.transform(ordered, lambda x: x["symbol"]), "").alias("signature"), gaps.cast("long").alias("gaps"), of("blank").alias("blank"), of("duplicate").alias("duplicate"), of("truncated").alias("truncated"), count(F.col("illegal")).alias("illegal")), "signatures")


def audits(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit, steps) of each distinct signature, solved once."""
    step = T.StructType([T.StructField("edit", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("role", T.StringType())])
    schema = T.StructType([T.StructField("signature", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("steps", T.ArrayType(step))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(pa.struct([("edit", pa.string()), ("row", pa.int32()), ("role", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.column(0).slice(at, 256).to_pylist()
                solved = [solve(x) for x in own]
                steps = [[dict(zip(("edit", "row", "role"), s)) for s in script(x, audit)] for x, (_, audit) in zip(own, solved)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string()), pa.array(steps, arrow)], names=schema.names)

    return materialise(signed.select("signature").distinct().mapInArrow(W.tidy(run), schema), "audits")


def replayed(marked: DataFrame, signed: DataFrame, solved: DataFrame) -> DataFrame:
    """(conversation, step, edit, role, text): the rows that are left, after all edits; inserted rows have an empty text.

    Signatures and audits are both written, so that adaptive execution can split the conversations of a frequent
    signature; steps then meet their rows by conversation and row.
    """
    steps = signed.select("conversation", "signature").join(solved.select("signature", "steps"), "signature").select("conversation", F.posexplode("steps").alias("step", "x"))
    steps = steps.select(F.col("conversation").alias("_conversation"), "step", "x.edit", F.col("x.row").alias("_row"), F.col("x.role").alias("_role")).filter("edit <> 'D'")
    met = steps.join(marked.select("conversation", "row", "role", "text"), F.col("_conversation").eqNullSafe(F.col("conversation")) & (F.col("_row") == F.col("row")), "left")
    return met.select(F.col("_conversation").alias("conversation"), "step", "edit", F.coalesce("_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def digests(turns: DataFrame, key: str = "conversation", order: str = "step", separator: str = "\n") -> DataFrame:
    """(key, sha256) of each conversation's ``role:text`` lines in order, joined by line feeds.

    Rows stream through a task in order and only the running digest is held, whatever a conversation's length.
    """
    schema = T.StructType([T.StructField("key", turns.schema[key].dataType), T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, now, digest = None, None, None
        for batch in batches:
            key_type = batch.column(0).type
            keys, found = [], []
            for k, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest is not None and k == now:
                    digest.update(separator.encode())
                else:
                    if digest is not None:
                        keys.append(now)
                        found.append(digest.hexdigest())
                    now, digest = k, hashlib.sha256()
                digest.update(line.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(found, pa.string())], names=schema.names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], key_type), pa.array([digest.hexdigest()], pa.string())], names=schema.names)

    line = F.concat("role", F.lit(":"), "text").cast("binary")
    dealt = turns.repartition(F.col(key)).sortWithinPartitions(key, order).select(F.col(key).alias("key"), line.alias("line"))
    return dealt.mapInArrow(run, schema).withColumnRenamed("key", key)


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, turns): one report row per conversation, and the rows of all conversations after their cheapest repair.

    The report has (conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). Rows with a null
    conversation form one. ``gaps`` counts the turns that are missing between the first and the last (all null: 0).
    Repeated rows are duplicates; an empty table gives empty results; other columns aren't read. A role that is
    empty or begins with another letter than s, u or a can't be kept.
    """
    marked = faults(rows, conversation, turn, role, text)
    signed = signatures(marked)
    solved = audits(signed)
    turns = materialise(replayed(marked, signed, solved), "repaired")
    found = digests(turns).select(F.col("conversation").alias("_conversation"), "sha256")
    report = signed.join(solved.select("signature", "cost", "audit"), "signature").join(found, F.col("conversation").eqNullSafe(F.col("_conversation")), "left")
    report = report.select(F.col("conversation").alias(conversation), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", _or_empty(F.col("sha256")).alias("repaired_sha256"))
    return report, turns.withColumnRenamed("conversation", conversation)


def _or_empty(digest: Column) -> Column:
    return F.coalesce(digest, F.sha2(F.lit(b""), 256))


def with_every(report: DataFrame, conversations: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The report with a row of zeros, an empty audit and the digest of nothing for each conversation that has no rows."""
    every = conversations.select(F.col(conversation).alias("_every")).distinct()
    met = every.join(report, F.col("_every").eqNullSafe(F.col(conversation)), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select(F.col("_every").alias(conversation), *zero, F.coalesce("audit", F.lit("")).alias("audit"), _or_empty(F.col("repaired_sha256")).alias("repaired_sha256"))


def damaged(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults planted by a checksum of ``conversation:turn`` (nulls: one space), as test data for ``repair``.

    Of 20 values, 0 drops the row, 1 empties its text, 2 removes all ``.!?``, 3 repeats the row, 4 makes the user its role.
    """
    word = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(word(conversation), F.lit(":"), word(turn)).cast("binary")) % 20).alias("_kind")
    own = rows.select(rows[conversation].alias(conversation), rows[turn].alias(turn), word(role).alias("_role"), word(text).alias("_text"), kind).filter("_kind <> 0")
    changed = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    made = own.select(conversation, turn, F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias(role), changed.alias(text), copies.alias("_copy"))
    return made.drop("_copy")
