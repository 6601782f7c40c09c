"""Repair of the structure of conversations, each distinct signature solved once.

A conversation's signature is a string of one character a row: what its role is, and whether the row must go or costs
one more to stay. All that the cheapest repair depends on is in it, so signatures are deduplicated, each is solved by
memoised recursion, and the audit (the initials of its edits) is joined back. Edits are then replayed on the rows
themselves, streamed in order behind one row that holds the audit.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: What may follow: nothing said yet, after system, after user, after assistant. A conversation may end at 0 or 3.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an inserted or rerolled row has in each state.
MADE = "uuau"
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1


def solve(signature: str) -> tuple[int, str]:
    """The least cost of a repair, and of the cheapest audits the ASCII-least.

    A character is the row's role (``s``, ``u``, ``a``, else ``x``), a capital if staying costs one more, or ``-`` if the
    row must go. The least cost from a place on is memoised by place and state; places are asked for from the end, so the
    recursion never goes deeper than a few insertions. As an edit's letter and the state settle what comes next, the
    least letter among the edits that lead to the least cost is always right.
    """
    n = len(signature)

    def edits(i: int, state: int, inserted: int) -> Iterator[tuple[str, int, int, int]]:
        """Letter, cost, and the place and state that follow; in order of letters."""
        made = NEXT[state, MADE[state]]
        if i < n:
            yield "D", DELETE, i + 1, state
        if inserted < 3:
            yield "I", INSERT, i, made
        if i < n and signature[i] != "-":
            role, extra = signature[i].lower(), CUT if signature[i].isupper() else 0
            if (state, role) in NEXT:
                yield "K", KEEP + extra, i + 1, NEXT[state, role]
            yield "R", REROLE + extra, i + 1, made

    @functools.cache
    def least(i: int, state: int, inserted: int = 0) -> float:
        """More than three insertions in a row never help: two reach any role."""
        done = 0.0 if i == n and state in (START, ASSISTANT) else float("inf")
        return min([done, *(cost + least(j, to, inserted + 1 if letter == "I" else 0) for letter, cost, j, to in edits(i, state, inserted))])

    for i in range(n, -1, -1):
        for state in range(4):
            least(i, state)
    i, state, inserted, audit = 0, START, 0, []
    total = left = least(0, START)
    while left or i < n:
        for letter, cost, j, to in edits(i, state, inserted):
            inserted_then = inserted + 1 if letter == "I" else 0
            if cost + least(j, to, inserted_then) == left:
                audit.append(letter)
                i, state, inserted, left = j, to, inserted_then, left - cost
                break
    return int(total), "".join(audit)


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [solve(s) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"])


def solve_signatures(scratch: Scratch, signatures: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of each distinct signature."""
    distinct = scratch.save(signatures.select("signature").distinct(), "signatures")
    return scratch.save(distinct.mapInArrow(_solve, "signature string, cost long, audit string"), "solved")


_SAID = r"[^\x20\x09-\x0D]"
_CUT = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, tie, copy, dropped`` after damage by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays as a mark of its conversation), 1 empties its text, 2 removes full stops, exclamation and
    question marks, 3 repeats it, 4 sets its role to user. Nulls are one space, those in the key of the checksum included. ``tie`` orders
    rows of one conversation and turn by what they were.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate"))
    tie = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.unhex(tie).alias("tie"), F.explode(copies).alias("copy"), (F.col("fate") == 0).alias("dropped"))


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def audit_structure(rows: DataFrame) -> DataFrame:
    """A row a conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, signature``.

    Texts stay where they are: what is dealt by conversation are digests and marks of rows.
    """
    blank = ~F.col("text").rlike(_SAID)
    marks = rows.select(
        "conv_id", "turn", "tie", "copy", "dropped", blank.alias("blank"), (~blank & F.col("text").rlike(_CUT)).alias("cut"), _initial(F.col("role")).alias("is"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("said")).repartition("conv_id")
    order = [F.asc_nulls_first("turn"), "tie", "copy"]
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "said").orderBy(*order)) > 1
    line = Window.partitionBy("conv_id", "dropped").orderBy(*order)
    placed = marks.withColumn("again", again).withColumns({"place": F.row_number().over(line), "was": F.lag("is").over(line), "before": F.lag("turn").over(line)})
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    kept = placed.withColumn("fault", fault)
    here = ~F.col("dropped")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper("is")).otherwise(F.col("is"))
    count = lambda c: F.count(F.when(here & c, 1))
    new_turn = F.col("turn").isNotNull() & ~F.col("before").eqNullSafe(F.col("turn"))
    turns = F.max(F.when(here, F.col("turn"))) - F.min(F.when(here, F.col("turn"))) + 1 - count(new_turn)
    illegal = F.col("was").isNotNull() & ~F.concat("was", "is").isin("su", "ua", "au")
    return kept.groupBy("conv_id").agg(
        F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), count(illegal).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(here, F.struct("place", mark.alias("mark"))))), lambda x: x["mark"]), "").alias("signature"))


_KEPT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, behind one that has the audit: the audit's row with the digest of the repaired conversation."""
    edits: Iterator[str] = iter("")
    state, sha, started, info = START, None, False, None
    names, types = [*_KEPT, "repaired_sha256"], None
    out: list[tuple] = []

    def say(role: str, text: str) -> None:
        nonlocal state, started
        sha.update((("\n" if started else "") + f"{role}:{text}").encode())
        started, state = True, NEXT.get((state, role[:1]), state)

    def until_row() -> str:
        """Insert until an edit takes a row; that edit, or nothing at the end."""
        for letter in edits:
            if letter != "I":
                return letter
            say(ROLES[MADE[state]], "")
        return ""

    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        types = types or [*(columns[n].type for n in _KEPT), pa.string()]
        for i, head in enumerate(columns["head"].to_pylist()):
            if head:
                if info is not None:
                    until_row()
                    out.append((*info, sha.hexdigest()))
                info = tuple(columns[n][i].as_py() for n in _KEPT)
                edits, state, sha, started = iter(info[-1]), START, hashlib.sha256(), False
                continue
            letter = until_row()
            if letter == "K":
                say(columns["role"][i].as_py(), columns["text"][i].as_py())
            elif letter == "R":
                say(ROLES[MADE[state]], columns["text"][i].as_py())
        if len(out) >= 1000:
            yield _batch(out, names, types)
            out = []
    if info is not None:
        until_row()
        out.append((*info, sha.hexdigest()))
    if out:
        yield _batch(out, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def replay(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """``audits`` with ``repaired_sha256``: of the repaired rows as ``role:text``, joined by line feeds. Texts are dealt once and streamed."""
    types = dict(audits.dtypes)
    key = types["conv_id"]
    heads = audits.select(*_KEPT, F.lit(True).alias("head"), *(F.lit(None).cast(t).alias(n) for n, t in (("turn", dict(rows.dtypes)["turn"]), ("tie", "binary"), ("copy", "int"), ("role", "string"), ("text", "string"))))
    lines = rows.filter(~F.col("dropped")).select("conv_id", *(F.lit(None).cast(types[n]).alias(n) for n in _KEPT[1:]), F.lit(False).alias("head"), "turn", "tie", "copy", "role", "text")
    placed = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), F.asc_nulls_first("turn"), "tie", "copy")
    return placed.mapInArrow(_replay, f"conv_id {key}, " + ", ".join(f"{n} {types[n]}" for n in _KEPT[1:]) + ", repaired_sha256 string")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Audit and repair of rows as ``damage`` gives them (conv_id, turn, role, text, tie, copy, dropped), a row a conversation.

    ``gaps`` are turn numbers that are missing between the least and the largest; ``blank``, ``duplicate`` and
    ``truncated`` count rows by their first fault; ``illegal`` counts neighbours whose role initials may not follow each
    other; ``cost`` and ``audit`` are the cheapest edits'; ``repaired_sha256`` is the digest of what they lead to. A
    conversation all of whose rows are dropped has zeros, an empty audit and the digest of nothing. Rows without
    conv_id are one conversation, with a null id. A role that begins with another character than s, u or a, or with none
    at all, can't be kept. Rows of one turn stand in order of the digests of what they were. Texts of any length
    are streamed; the signature and the audit of a conversation are one string each. An empty table gives no rows. The result
    is a table in the shared folder; all others that were written are removed.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    found = scratch.save(audit_structure(rows), "structure")
    # written tables on both sides: the conversations of one signature can be split among tasks
    audits = found.join(solve_signatures(scratch, found), "signature").select(*_KEPT)
    return scratch.last(replay(audits, rows))
