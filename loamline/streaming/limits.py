"""Stateful operators: rate limits, joint admission, a concurrency gate, progress, replay, agent guards.

The folds are plain Python on one key's events in order. Rate limits and
admission run the same fold per key in batch and over state kept by Spark in
streaming; the others are for batch.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECISION = "client string, seq long, ts double, allowed boolean, in_window int, retry_after int"
# The guards of an agent's loop.
MOST_ROUNDS, MOST_EQUAL, OVERLAP, MOST_OUTPUT = 8, 2, 0.6, 60_000


def admit(stamps: deque, ts: float, window: float, most: int) -> tuple[bool, int, int]:
    """Accept at most ``most`` events in (ts - window, ts]; only accepted ones count. (allowed, in the window after, seconds to wait)."""
    while stamps and stamps[0] <= ts - window:
        stamps.popleft()
    if len(stamps) < most:
        stamps.append(ts)
        return True, len(stamps), 0
    return False, len(stamps), max(1, math.ceil(stamps[0] + window - ts)) if stamps else max(1, math.ceil(window))


def fold_limits(rows: Iterable[tuple[int, float, str]], stamps: deque, window: float, most: int) -> Iterator[tuple]:
    """Decisions on (seq, ts, op); a ``refund`` takes the latest accepted stamp back."""
    for seq, ts, op in rows:
        if op == "refund":
            if stamps:
                stamps.pop()
            continue
        yield (seq, ts, *admit(stamps, ts, window, most))


def rate_limit(events: DataFrame, window: float, most: int) -> DataFrame:
    """Decision on every submission (``client``, ``seq``, ``ts`` in seconds, ``op``); a client's own events are folded in order of time."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(["ts", "seq"])[["seq", "ts", "op"]].itertuples(index=False, name=None)
        return pd.DataFrame([(key[0], *d) for d in fold_limits(rows, deque(), window, most)], columns=[x.split()[0] for x in DECISION.split(", ")])

    return events.select("client", "seq", "ts", "op").groupBy("client").applyInPandas(run, DECISION)


class RateLimiter(StatefulProcessor):
    """``rate_limit`` over a stream; a client's stamps expire with the window."""

    def __init__(self, window: float, most: int):
        self.window, self.most = window, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stamps = handle.getValueState("stamps", "stamps array<double>", int(self.window * 1000))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        kept = deque(self.stamps.get()[0]) if self.stamps.exists() else deque()
        part = pd.concat(list(rows)).sort_values(["ts", "seq"])[["seq", "ts", "op"]]
        out = [(key[0], *d) for d in fold_limits(part.itertuples(index=False, name=None), kept, self.window, self.most)]
        self.stamps.update((list(kept),))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in DECISION.split(", ")])

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, window: float, most: int) -> DataFrame:
    """The same over a streaming DataFrame; needs the RocksDB state store."""
    return events.groupBy("client").transformWithStateInPandas(RateLimiter(window, most), DECISION, "append", "processingTime")


def fold_gate(rows: Iterable[tuple[int, str, str]], slots: int, queue: int) -> Iterator[tuple[int, str, str, int, str | None]]:
    """(seq, task, result, place in the queue, promoted task) for acquire and release operations.

    Acquiring again is no new request. A release starts the head of the queue.
    """
    running: dict[str, None] = {}
    waiting: deque[str] = deque()
    for seq, op, task in rows:
        promoted, place = None, 0
        if op == "acquire":
            if task in running:
                result = "running"
            elif task in waiting:
                result = "queued"
            elif len(running) < slots:
                running[task] = None
                result = "running"
            elif len(waiting) < queue:
                waiting.append(task)
                result = "queued"
            else:
                result = "rejected"
            place = waiting.index(task) + 1 if task in waiting else 0
        else:
            result = "released" if task in running or task in waiting else "unknown"
            if task in running:
                del running[task]
                if waiting:
                    promoted = waiting.popleft()
                    running[promoted] = None
            elif task in waiting:
                waiting.remove(task)
        yield seq, task, result, place, promoted


def gate(ops: DataFrame, slots: int, queue: int, by: str = "gate") -> DataFrame:
    """Results of a gate's operations in order; a gate is one installation's, so its operations are one sequence, which streams through a task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = (row for part in parts for row in part[["gate", "seq", "op", "task_id"]].itertuples(index=False, name=None))
        rows = []
        for name, own in groupby(sequence, key=lambda r: r[0]):
            for row in fold_gate((r[1:] for r in own), slots, queue):
                rows.append((name, *row))
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=GATE_COLUMNS)
                    rows = []
        yield pd.DataFrame(rows, columns=GATE_COLUMNS)

    own = ops.select(F.col(by).cast("string").alias("gate"), "seq", "op", "task_id")
    return own.repartition("gate").sortWithinPartitions("gate", "seq").mapInPandas(run, "gate string, seq long, task_id string, result string, place int, promoted string")


GATE_COLUMNS = ["gate", "seq", "task_id", "result", "place", "promoted"]


def admission(credentials: Column, allowed: Column, url_ok: Column, fits: Column, gate_result: Column) -> Column:
    """First test a submission fails: credentials, rate limit, URL, quota, gate; ``accepted`` or ``queued`` otherwise."""
    return F.when(~credentials, "no_credentials").when(~allowed, "rate_limited").when(~url_ok, "invalid_url").when(~fits, "no_space").when(gate_result == "rejected", "queue_full").when(gate_result == "queued", "queued").otherwise("accepted")


ADMISSION = "client string, seq long, ts double, decision string, in_window int, retry_after int"


def fold_admissions(rows: Iterable[tuple], stamps: deque, window: float, most: int) -> Iterator[tuple]:
    """Decisions on a client's (seq, ts, op, credentials, url_ok, fits, gate_result): (seq, ts, decision, stamps in the window, seconds to wait).

    The tests come in the order of ``admission``. The rate is asked second, but
    a stamp is only taken once every later test has let the submission pass, so
    what the service refuses for its own lack of room costs the client nothing.
    A ``refund`` takes the latest stamp back.
    """
    for seq, ts, op, credentials, url_ok, fits, gate_result in rows:
        if op == "refund":
            if stamps:
                stamps.pop()
            continue
        while stamps and stamps[0] <= ts - window:
            stamps.popleft()
        wait = 0
        if not credentials:
            decision = "no_credentials"
        elif len(stamps) >= most:
            decision = "rate_limited"
            wait = max(1, math.ceil((stamps[0] if stamps else ts) + window - ts))
        elif not url_ok:
            decision = "invalid_url"
        elif not fits:
            decision = "no_space"
        elif gate_result == "rejected":
            decision = "queue_full"
        else:
            stamps.append(ts)
            decision = "queued" if gate_result == "queued" else "accepted"
        yield seq, ts, decision, len(stamps), wait


ADMITTED_BY = ["seq", "ts", "op", "credentials", "url_ok", "fits", "gate_result"]


def admissions(submissions: DataFrame, window: float, most: int) -> DataFrame:
    """Decision on every submission (``client`` and ADMITTED_BY; ``ts`` in seconds) by one state machine a client.

    Clients are dealt over the tasks and each task's rows stream through it in
    order, so no client is held as a whole; a task holds one client's stamps.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ADMISSION.split(", ")]
        client, stamps = None, deque()
        for part in parts:
            rows = []
            for who, own in groupby(part[["client", *ADMITTED_BY]].itertuples(index=False, name=None), key=lambda r: r[0]):
                if who != client:
                    client, stamps = who, deque()
                rows += [(who, *d) for d in fold_admissions((r[1:] for r in own), stamps, window, most)]
            yield pd.DataFrame(rows, columns=names)

    own = submissions.select("client", *ADMITTED_BY)
    return own.repartition("client").sortWithinPartitions("client", "ts", "seq").mapInPandas(run, ADMISSION)


class Admissions(StatefulProcessor):
    """``admissions`` over a stream; a client's stamps expire with the window."""

    def __init__(self, window: float, most: int):
        self.window, self.most = window, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stamps = handle.getValueState("stamps", "stamps array<double>", int(self.window * 1000))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        kept = deque(self.stamps.get()[0]) if self.stamps.exists() else deque()
        part = pd.concat(list(rows)).sort_values(["ts", "seq"])[ADMITTED_BY]
        out = [(key[0], *d) for d in fold_admissions(part.itertuples(index=False, name=None), kept, self.window, self.most)]
        if kept:
            self.stamps.update((list(kept),))
        else:
            self.stamps.clear()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ADMISSION.split(", ")])

    def close(self) -> None:
        pass


def admissions_stream(submissions: DataFrame, window: float, most: int) -> DataFrame:
    """The same over a streaming DataFrame; needs the RocksDB state store."""
    return submissions.groupBy("client").transformWithStateInPandas(Admissions(window, most), ADMISSION, "append", "processingTime")


def progress(events: DataFrame) -> DataFrame:
    """Monotone percent of every task's events (``task_id``, ``seq``, ``percent``, ``failed``); null on a terminal failure."""
    w = Window.partitionBy("task_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("shown", F.when(~F.col("failed"), F.max("percent").over(w)))


def replay(history: DataFrame, live: DataFrame, most: int = 200) -> DataFrame:
    """A subscriber's view of a task: the last ``most`` past events, then the live ones, in order."""
    from loamline.operators.ranking import last_n

    past = last_n(history, ["task_id"], "seq", most).withColumn("origin", F.lit("replay"))
    fresh = live.join(history.groupBy("task_id").agg(F.max("seq").alias("__last")), "task_id", "left").where(F.col("__last").isNull() | (F.col("seq") > F.col("__last"))).drop("__last")
    return past.unionByName(fresh.withColumn("origin", F.lit("live")))


def agent_guards(calls: DataFrame) -> DataFrame:
    """Why an agent's call should end its loop, null if not.

    ``task_id``, ``seq``, ``round``, ``tool``, ``arguments``, ``path``,
    ``start``, ``end``, ``output_chars``. A call repeated more than twice, a
    read that an earlier one covers by 60 %, more than eight rounds, more than
    60 000 characters of output.
    """
    from loamline.operators.ranking import covered_before

    w = Window.partitionBy("task_id").orderBy("seq")
    same = F.count(F.lit(1)).over(Window.partitionBy("task_id", "tool", "arguments").orderBy("seq"))
    reads = covered_before(calls.where("path is not null").select("task_id", "path", "seq", "start", "end"), ["task_id", "path"], OVERLAP)
    cover = reads.where("covered").select("task_id", "seq", "covered")
    out = calls.withColumns({"same": same, "output": F.sum("output_chars").over(w.rowsBetween(Window.unboundedPreceding, 0))}).join(cover, ["task_id", "seq"], "left")
    stop = F.when(F.col("round") > MOST_ROUNDS, "rounds").when(F.col("same") > MOST_EQUAL, "repeated").when(F.col("covered"), "overlap").when(F.col("output") > MOST_OUTPUT, "output")
    return out.withColumn("stop", stop).drop("same", "covered", "output")


def forced_summary(stopped: DataFrame) -> DataFrame:
    """Rows of agents that were stopped (``name``, ``reply``, ``stop``): a failure if the summary they were asked for is blank or degenerate, else an analysis with its limitation."""
    from loamline.functions import text

    shown = text.without_thinking(F.coalesce("reply", F.lit("")))
    useless = (F.trim(shown) == "") | text.degenerate(shown)
    return stopped.select("name", F.when(useless, "failed").otherwise("analysed").alias("state"), F.when(~useless, shown).alias("summary"), F.when(~useless, F.concat(F.lit("stopped early: "), "stop")).alias("limitation"))


def read_range(start: Column, end: Column) -> tuple[Column, Column]:
    """A read's range: start 1 unless a whole number, end 199 after it unless given."""
    s = F.greatest(F.coalesce(start.try_cast("int"), F.lit(1)), F.lit(1))
    return s, F.coalesce(end.try_cast("int"), s + 199)
