"""Ingestion-progress tracker (E01 / E02): batch twin and stateful stream.

The tracker polls a row count every ``poll_s`` seconds. It emits a status only when the count
changes; it finishes when the count reaches the limit or when it has not changed for more than
``idle_s``; it aborts when no row at all has arrived more than ``abort_s`` after the start.

Batch twin: the poll instants are a grid from the request time, each arrival belongs to the
first poll at or after it, so statuses are the distinct poll indices with arrivals - a
pre-aggregated (account, poll) count followed by a window over the account's polls. The limit
check (count >= limit, inclusive) and the idle check (gap > idle, strict) cut the sequence.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventide.config import SECOND_US, TRACKER_ABORT_S, TRACKER_IDLE_S, TRACKER_POLL_S
from eventide.functions.time import epoch_us, from_epoch_us
from eventide.session import use_timed_state


@dataclass(frozen=True)
class TrackerParams:
    poll_s: int = TRACKER_POLL_S
    idle_s: int = TRACKER_IDLE_S
    abort_s: int = TRACKER_ABORT_S


def progress_batch(arrivals: DataFrame, requests: DataFrame, p: TrackerParams = TrackerParams(),
                   *, arrival_col: str = "arrival_time") -> DataFrame:
    """E01 batch twin.

    arrivals: AccountId, ``arrival_col`` (one row per ingested row).
    requests: AccountId, requested_at (timestamp), total_no_of_records (the limit).
    Returns one row per emitted status: AccountId, requested_at, poll, poll_time, no_of_records,
    total_no_of_records, is_last (the status the training start carries). Requests of an account
    are followed apart; equal ones (several models asked for at once) are one. Poll 0 counts what
    was there at the request. Requests that abort emit nothing.
    """
    poll_us = int(p.poll_s) * SECOND_US
    key = ["AccountId", "_t0", "_limit"]
    req = requests.select("AccountId", epoch_us("requested_at").alias("_t0"),
                          F.col("total_no_of_records").cast("bigint").alias("_limit")).distinct()
    # rows of one instant first: what meets the requests is one row per (account, instant)
    arr = arrivals.groupBy("AccountId", epoch_us(arrival_col).alias("_a")).agg(F.count(F.lit(1)).alias("_k"))
    poll = F.greatest(F.lit(0), F.ceil((F.col("_a") - F.col("_t0")) / F.lit(poll_us))).cast("bigint")
    polls = arr.join(req, "AccountId", "inner").groupBy(*key, poll.alias("poll")).agg(F.sum("_k").alias("_n"))
    w = Window.partitionBy(*key).orderBy("poll")
    cum = polls.select(
        "*",
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("no_of_records"),
        F.lag("poll").over(w).alias("_prev_poll"),
        F.min("poll").over(Window.partitionBy(*key)).alias("_first_poll"),
    )
    cum = cum.withColumn("_prev_count", F.lag("no_of_records").over(w))
    stop = ((F.col("_prev_count") >= F.col("_limit"))
            | ((F.col("poll") - F.col("_prev_poll")) * F.lit(p.poll_s) > F.lit(p.idle_s)))
    cum = cum.withColumn("_stop", F.coalesce(stop, F.lit(False)).cast("int"))
    cum = cum.withColumn("_stopped", F.max("_stop").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    alive = cum.where((F.col("_stopped") == 0)
                      & ~(F.col("_first_poll") * F.lit(p.poll_s) > F.lit(p.abort_s)))
    last = F.max("poll").over(Window.partitionBy(*key))
    return alive.select(
        "AccountId", from_epoch_us(F.col("_t0")).alias("requested_at"), "poll",
        from_epoch_us(F.col("_t0") + F.col("poll") * F.lit(poll_us)).alias("poll_time"),
        F.col("no_of_records").cast("bigint").alias("no_of_records"),
        F.col("_limit").alias("total_no_of_records"),
        (F.col("poll") == last).alias("is_last"),
    )


def training_starts(progress: DataFrame, requests: DataFrame) -> DataFrame:
    """A training-start message (final count) for every request that did not abort.

    Requests that carry requested_at and total_no_of_records meet their own progress; requests
    without a time meet the account's.
    """
    own = [c for c in ("requested_at", "total_no_of_records") if "requested_at" in requests.columns]
    fin = progress.where("is_last").select("AccountId", *own, "no_of_records")
    return requests.join(fin, ["AccountId", *own], "inner").select(
        "AccountId", "ApplicationId", "ModelId", "task_type", "no_of_records")


# ---- streaming form ---------------------------------------------------------------------------

OUTPUT_SCHEMA = ("AccountId long, request string, no_of_records long, total_no_of_records long, "
                 "finished boolean, aborted boolean")
OUTPUT = ["AccountId", "request", "no_of_records", "total_no_of_records", "finished", "aborted"]
#: the state variable that holds the open requests; empty when nothing is left to follow
OPEN = "open"


class RequestTracker(StatefulProcessor):
    """E01 stream: the requests of one account, each with its own end.

    Rows are counts of arrivals (``n``) and requests (``asked``: name -> limit as JSON). An open request
    gets a status when the count changes, the first one as soon as there is a count. It is done when
    the count reaches its limit, or when nothing has changed for more than ``idle_s``; it aborts when
    more than ``abort_s`` after it was made still no row is there. One timer per account stands at the
    earliest end of its open requests, so an account without open requests has none.

    Ended requests leave the state. ``standing`` requests come with every batch: a name that is done
    stays done while it is asked for. Otherwise a request comes once, as a message; the same one is
    open again when it comes after the end of the first. Rows that nobody asks for are counted.
    """

    def __init__(self, p: TrackerParams = TrackerParams(), *, standing: bool = True) -> None:
        self.p, self.standing = p, standing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "count long, changed long")
        self.open = handle.getMapState(OPEN, "request string", "total long, since long")
        self.done = handle.getMapState("done", "request string", "at long")
        self.due = handle.getValueState("due", "at long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803, ANN001
        self.seen.update((int(initialState["n"].sum()), timerValues.getCurrentProcessingTimeInMs()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        n, asked = 0, {}
        for pdf in rows:
            n += int(pdf["n"].sum())
            for text in pdf["asked"].dropna().unique():
                asked.update(json.loads(text))
        yield from self._turn(key[0], timerValues.getCurrentProcessingTimeInMs(), n, asked, self.standing)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        self.due.clear()
        yield from self._turn(key[0], timerValues.getCurrentProcessingTimeInMs(), 0, {}, False)

    def _turn(self, account: int, now: int, n: int, asked: dict[str, int], only_asked: bool) -> Iterator[pd.DataFrame]:
        count, changed = self.seen.get() if self.seen.exists() else (0, now)
        if n or not self.seen.exists():
            count, changed = count + n, now if n else changed
            self.seen.update((count, changed))
        waiting = {k[0]: v for k, v in self.open.iterator()}
        done = {k[0] for k in self.done.keys()} if self.standing else set()
        if only_asked:
            for name in [x for x in waiting if x not in asked]:
                self.open.removeKey((name,))
                del waiting[name]
            for name in [x for x in done if x not in asked]:
                self.done.removeKey((name,))
                done.remove(name)
        new = {k: (int(v), now) for k, v in asked.items() if k not in waiting and k not in done}
        for name, value in new.items():
            self.open.updateValue((name,), value)
        told, ends = [], []
        for name, (limit, since) in {**waiting, **new}.items():
            if count:
                end = max(changed, since) + int(self.p.idle_s * 1000) + 1
                over = count >= limit or now >= end
            else:
                end = since + int(self.p.abort_s * 1000) + 1
                over = now >= end
            if over:
                told.append((account, name, count, limit, count > 0, count == 0))
                self.open.removeKey((name,))
                if self.standing:
                    self.done.updateValue((name,), (now,))
                continue
            ends.append(end)
            if count and (n or name in new):
                told.append((account, name, count, limit, False, False))
        self._timer(min(ends, default=None))
        if told:
            yield pd.DataFrame(told, columns=OUTPUT)

    def _timer(self, at: int | None) -> None:
        before = self.due.get()[0] if self.due.exists() else None
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.due.clear()
        else:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def close(self) -> None:
        pass


def _task_counts(arrivals: DataFrame) -> DataFrame:
    """(AccountId, n): arrivals counted per task, so a hot account is one row of a task."""

    def run(pdfs):
        total = {}
        for pdf in pdfs:
            for account, n in pdf["AccountId"].value_counts().items():
                total[account] = total.get(account, 0) + int(n)
        if total:
            yield pd.DataFrame({"AccountId": list(total), "n": list(total.values())})

    return (arrivals.where("AccountId is not null").select(F.col("AccountId").cast("long"))
            .mapInPandas(run, "AccountId long, n long"))


def progress_stream(arrivals_stream: DataFrame, limit: int | DataFrame, p: TrackerParams = TrackerParams(),
                    *, stored: DataFrame | None = None) -> DataFrame:
    """E01 over a stream of arrivals (AccountId, ...): status rows as they change.

    ``limit`` is one number for every account, a table of standing requests (AccountId,
    total_no_of_records and, if there, requested_at), or a stream of requests (AccountId, request,
    total_no_of_records). A stream of requests opens state for an account by itself, so a request
    of an account without any row aborts in time. The requests of an account are one row beside its
    counts, so several requests do not multiply its arrivals. ``stored`` (AccountId, ...) are rows that
    were there before the stream began; they count from the first run on.

    Timers wait for the clock, so ``availableNow`` would never end: run it with a processing-time
    trigger, or for as long as a request is open with ``flows.run_until_closed``.
    """
    use_timed_state(arrivals_stream.sparkSession)
    counted = _task_counts(arrivals_stream)
    if not isinstance(limit, DataFrame):
        rows = counted.withColumn("asked", F.lit('{"all": %d}' % int(limit)))
    elif limit.isStreaming:
        one = F.to_json(F.create_map("request", F.col("total_no_of_records").cast("bigint")))
        rows = counted.withColumn("asked", F.lit(None).cast("string")).unionByName(
            limit.select(F.col("AccountId").cast("long"), F.lit(0).cast("long").alias("n"), one.alias("asked")))
    else:
        named = [c for c in ("requested_at", "total_no_of_records") if c in limit.columns]
        asked = limit.select("AccountId", F.concat_ws("|", *[F.col(c).cast("string") for c in named]).alias("k"),
                             F.col("total_no_of_records").cast("bigint").alias("v")).distinct()
        asked = asked.groupBy("AccountId").agg(
            F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("asked"))
        rows = counted.join(asked, "AccountId", "left")
    standing = not (isinstance(limit, DataFrame) and limit.isStreaming)
    first = None
    if stored is not None:
        first = stored.where("AccountId is not null").groupBy(F.col("AccountId").cast("long").alias("AccountId")).agg(
            F.count(F.lit(1)).alias("n")).groupBy("AccountId")
    return rows.groupBy("AccountId").transformWithStateInPandas(
        RequestTracker(p, standing=standing), OUTPUT_SCHEMA, "Append", "ProcessingTime", first)


def open_requests(spark: SparkSession, checkpoint: str) -> int:
    """How many requests the stream at ``checkpoint`` still follows, after its last finished batch."""
    return (spark.read.format("statestore").option("path", checkpoint).option("stateVarName", OPEN)
            .load().count())
