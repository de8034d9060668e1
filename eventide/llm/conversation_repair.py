"""Repair of conversation structure by generalised LR parsing with weighted edits (operator 12).

Roles follow ``[system] (user assistant)+``, or nothing. A parse reads the turns of a conversation in
order (turn, nulls first; equal turns by role, then text) and may keep (K, 0), rerole to user or
assistant (R, 3), delete (D, 4) or insert an empty turn (I, 3) anywhere. Blank and repeated turns must
go; a truncated one that stays costs 3 more.

*Stack.* A graph-structured stack has at most one node per LR state on top (``START``, ``SYSTEM``,
``USER``, ``PAIRS``): a finished pair is reduced at once, and what lies below a top never changes the
actions above it. Equal tops merge into the one of least (cost, audit); the audit, the edits'
initials, is the path through the stack. Audits of equal cost over the same turns never begin with
one another, so the least one stays least whatever follows.

*Long conversations.* Turns are dealt by range of (conversation, turn), so a conversation of a third of
all rows spans many tasks. A task parses runs of at most ``SEGMENT_ROWS`` turns; a run that may begin in
the middle of a conversation is parsed from every top. Runs then combine in order, top by top, which
is the same minimum. Combining, rendering and digests stream through sorted partitions: a task holds
the edits of one conversation, never its turns.

*Repeats* within a conversation are found by an aggregation over (role, text digest) first, so no task
remembers the texts of a conversation.

Null role and text read as one space, null ``conv_id`` is a conversation of its own, null turns come
first. A turn whose role is empty, or none of the grammar's, cannot be kept as it is. A conversation without a visible turn is repaired to nothing. Empty tables give no rows; only
conv_id, turn, role and text are read, so other columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import read
from eventide.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, PAIRS = range(4)
#: shift actions by (top, initial of the role); the shift of an answer reduces the pair at once
SHIFT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (PAIRS, "u"): USER, (USER, "a"): PAIRS}
ACCEPT = (START, PAIRS)
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
SEGMENT_ROWS = 1024
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]

Front = dict[int, tuple[int, str]]  # top -> (cost, audit)


# ---- the parse --------------------------------------------------------------------------------

def _offer(front: Front, top: int | None, cost: int, audit: str) -> None:
    """Merge a node into the front: equal tops keep the least (cost, audit)."""
    if top is not None and (top not in front or (cost, audit) < front[top]):
        front[top] = (cost, audit)


def inserted(front: Front) -> Front:
    """The front with every useful insertion; two in a row complete a pair, more repeat a top."""
    out = dict(front)
    for _ in range(2):
        for top, (cost, audit) in list(out.items()):
            for role in ROLES:
                _offer(out, SHIFT.get((top, role)), cost + INSERT, audit + "I")
    return out


def advanced(front: Front, initial: str, must_go: bool, late: bool) -> Front:
    """The front after one turn: delete, keep or rerole from every top, with insertions before it."""
    out: Front = {}
    extra = TRUNCATED if late else 0
    for top, (cost, audit) in inserted(front).items():
        _offer(out, top, cost + DELETE, audit + "D")
        if not must_go:
            _offer(out, SHIFT.get((top, initial)), cost + KEEP + extra, audit + "K")
            for role in ROLES:
                if role != initial:
                    _offer(out, SHIFT.get((top, role)), cost + REROLE + extra, audit + "R")
    return out


def accepted(front: Front) -> tuple[int, str]:
    return min(node for top, node in inserted(front).items() if top in ACCEPT)


def combined(front: Front, segment: dict[int, Front]) -> Front:
    """The front after a segment, given the segment's fronts from each top."""
    out: Front = {}
    for top, (cost, audit) in front.items():
        for end, (more, edits) in segment.get(top, {}).items():
            _offer(out, end, cost + more, audit + edits)
    return out


# ---- first pass: faults and segments ----------------------------------------------------------

def _clean(turns: DataFrame) -> DataFrame:
    one = F.lit(" ")
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", one).alias("role"),
                        F.coalesce("text", one).alias("text"))


def _repeats(rows: DataFrame) -> DataFrame:
    """Rows with ``seen``: the conversation has the same role and text in an earlier turn."""
    said = F.unhex(F.sha2("text", 256))
    first = (rows.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), said.alias("_said"))
             .agg(F.min("turn").alias("_since"), F.max("turn").alias("_last"),
                  F.bool_or(F.col("turn").isNull()).alias("_null"))
             .where("_last is not null and (_null or _since < _last)"))
    first = cut_lineage(first, "repair-repeats")
    same = (F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role"))
            & (said == F.col("_said")))
    seen = F.coalesce(F.col("turn").isNotNull() & (F.col("_null") | (F.col("turn") > F.col("_since"))), F.lit(False))
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", seen.alias("seen"))


def _marked(turns: DataFrame, segment_rows: int) -> DataFrame:
    """Turns in order, and their segments: rows told apart by ``place``.

    * place i: the i-th turn of segment ``seg`` of its conversation; segments are numbered in order;
    * place -1: the segment's fronts from each top it may begin with, and its counts, as JSON.
    """
    start = F.substring("text", 1, 64)
    rows = _repeats(_clean(turns))
    # equal rows share a task; keys that a task's bounds are sampled from stay short
    rows = (rows.repartitionByRange("conv_id", "turn", "role", start)
            .sortWithinPartitions("conv_id", "turn", "role", "text"))
    kind = turns.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, seg long, place int, role string, text string, body string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        none = object()
        conv, seg, n, before = none, 0, 0, none
        tops: tuple[int, ...] = (START, SYSTEM, USER, PAIRS)  # the task's first run may go on from another task
        fronts: dict[int, Front] = {}
        info: dict = {}
        key_type = None

        def closing(out: list[tuple]) -> None:
            body = {"fronts": {t: f for t, f in fronts.items()}, **info}
            out.append((conv, (task << 32) + seg, -1, None, None, json.dumps(body)))

        def batch(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [key_type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                              names=["conv_id", "seg", "place", "role", "text", "body"])

        for b in batches:
            key_type = b.schema.field(0).type
            out: list[tuple] = []
            for c, turn, role, text, seen in zip(*(col.to_pylist() for col in b.columns)):
                if conv is none or c != conv or n == segment_rows:
                    if conv is not none:
                        closing(out)
                        seg += 1
                        if c != conv:
                            tops, before = (START,), none
                        else:
                            tops = (START, SYSTEM, USER, PAIRS)
                    conv, n = c, 0
                    fronts = {t: {t: (0, "")} for t in tops}
                    info = {"rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0,
                            "low": None, "high": None, "first": role[:1], "last": role[:1]}
                said = text.strip(SPACE)
                own = (c, turn, role, text)
                blank = not said
                again = not blank and (seen or own == before)
                late = not blank and not again and said[-1] not in ".!?"
                for name, fault in (("blank", blank), ("duplicate", again), ("truncated", late)):
                    info[name] += fault
                initial = role[:1]
                info["illegal"] += info["rows"] > 0 and info["last"] + initial not in LEGAL
                if turn is not None:
                    info["turns"] += turn != info["high"]
                    info["low"] = turn if info["low"] is None else info["low"]
                    info["high"] = turn
                info["last"], info["rows"] = initial, info["rows"] + 1
                fronts = {t: advanced(f, initial, blank or again, late) for t, f in fronts.items()}
                out.append((conv, (task << 32) + seg, n, role, text, None))
                before, n = own, n + 1
            if out:
                yield batch(out)
        if conv is not none:
            last: list[tuple] = []
            closing(last)
            yield batch(last)

    return cut_lineage(rows.mapInArrow(run, schema), "repair-turns")


# ---- combining --------------------------------------------------------------------------------

def _reports(marked: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost and audit of the cheapest repair."""
    kind = marked.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in [*COUNTS, "cost"]) + ", audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, front, total = none, {}, {}
        key_type = None

        def report() -> tuple:
            gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
            return (conv, gaps, *(total[c] for c in COUNTS[1:]), *accepted(front))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [key_type, *[pa.int64()] * (len(COUNTS) + 1), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                              names=["conv_id", *COUNTS, "cost", "audit"])

        for b in batches:
            key_type = b.schema.field(0).type
            out = []
            for c, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seg = json.loads(body)
                fronts = {int(t): {int(e): tuple(node) for e, node in f.items()} for t, f in seg["fronts"].items()}
                if conv is none or c != conv:
                    if conv is not none:
                        out.append(report())
                    conv, front = c, {START: (0, "")}
                    total = {**dict.fromkeys([*COUNTS[1:], "turns"], 0), "low": None, "high": None, "last": None}
                for name in (*COUNTS[1:], "turns"):
                    total[name] += seg[name]
                if total["last"] is not None:
                    total["illegal"] += total["last"] + seg["first"] not in LEGAL
                if seg["low"] is not None:
                    total["turns"] -= seg["low"] == total["high"]
                    total["low"] = seg["low"] if total["low"] is None else total["low"]
                    total["high"] = seg["high"]
                total["last"] = seg["last"]
                front = combined(front, fronts)
            if out:
                yield batch(out)
        if conv is not none:
            yield batch([report()])

    segments = marked.where("place = -1").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return cut_lineage(segments.select("conv_id", "body").mapInArrow(run, schema), "repair-reports")


def _repaired(marked: DataFrame, reports: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, position, edit, role, text.

    A conversation's turns lie in one partition, in order, for readers that go on from turn to turn.
    """
    kind = marked.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, position long, edit string, role string, text string"
    edits = reports.select("conv_id", F.lit(-1).cast("long").alias("seg"), F.lit(-1).alias("place"),
                           F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    stream = (marked.where("place >= 0").drop("body").unionByName(edits).repartition("conv_id")
              .sortWithinPartitions("conv_id", "seg", "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, tail, top, position = None, "", 0, 0, START, 0
        key_type = None
        out: list[tuple] = []

        def put(edit: str, initial: str, role: str, text: str) -> None:
            nonlocal top, position
            out.append((conv, position, edit, role, text))
            top, position = SHIFT[top, initial], position + 1

        def insertions() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                due = "a" if top == USER else "u"
                put("I", due, ROLES[due], "")
                at += 1

        for b in batches:
            key_type = b.schema.field(0).type
            for c, place, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if place < 0:  # the edits of the next conversation
                    conv, audit, at, top, position = c, text, 0, START, 0
                    tail = len(audit.rstrip("I"))
                    continue
                insertions()
                edit, at = audit[at], at + 1
                if edit == "K":
                    put("K", role[:1], role, text)
                elif edit == "R":
                    due = "a" if top == USER else "u"
                    put("R", due, ROLES[due], text)
                if at == tail:
                    insertions()  # after the last turn
            if out:
                types = [key_type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)],
                                                 names=["conv_id", "position", "edit", "role", "text"])
                out.clear()

    return stream.select("conv_id", "place", "role", "text").mapInArrow(run, schema)


def repair(turns: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired turns) of conversations given as rows conv_id, turn, role, text."""
    marked = _marked(turns, segment_rows)
    reports = _reports(marked)
    return reports, _repaired(marked, reports)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines, from turns in the order ``repair`` gives them."""
    kind = repaired.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, key_type = None, None, None

        def batch(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], key_type),
                                               pa.array([d[1] for d in done], pa.string())],
                                              names=["conv_id", "repaired_sha256"])

        for b in batches:
            key_type = b.schema.field(0).type
            done = []
            for c, position, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                line = f"{role}:{text}".encode()
                if position == 0:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256(line)
                else:
                    sha.update(b"\n" + line)
            if done:
                yield batch(done)
        if sha is not None:
            yield batch([(conv, sha.hexdigest())])

    return (repaired.select("conv_id", "position", "role", "text")
            .mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string"))


# ---- the query --------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut short, repeated or given the role user, by crc32 of ``conv_id:turn``."""
    one = F.lit(" ")

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), one)

    way = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                                way.alias("way")).where("way <> 0")
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op12: all conversations damaged, then repaired; one row per original conversation."""
    given = read(spark, sf_dir, "conversations")
    reports, repaired = repair(damaged(given))
    found = reports.join(digests(repaired).withColumnRenamed("conv_id", "_conv"),
                         F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    every = given.select(F.col("conv_id").alias("_conv")).distinct()
    empty = hashlib.sha256(b"").hexdigest()
    return every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*COUNTS, "cost"]],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
