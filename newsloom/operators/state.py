"""State machines over ordered events: sorted folds per key for tables, the same steps for streams.

A machine is a pure step(state, event) -> (state, outputs). ``fold`` runs it over the
events of each key in order; newsloom.streaming runs it on a stream.

Events are dealt in ranges of key and time, so that one key may fill many tasks. What a stretch of events does to a state
that it does not know yet is a small summary (``SUMMARIES``): the states of a machine are few, and what time
adds to them is the start or the last day. A first pass makes the summary of each range's first key, the driver runs along them,
and the second pass runs the machine from the states it has found. ``gap_step`` and ``cooldown_step`` have no such
summary (where they are depends on every time within the window): there, all events of a key are streamed through one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.storage import kept

HOUR = timedelta(hours=1)


def outage_step(state: tuple | None, ts: datetime, kind: str, second: timedelta = HOUR, fallback: timedelta = 2 * HOUR) -> tuple[tuple | None, str | None]:
    """Outage pings: at once, after an hour, and the fallback two hours from the start; one transition per event.

    The state is (start, level). A recovery clears it with one ping, and is nothing without an outage.
    """
    if kind == "recovery":
        return None, "recovered" if state else None
    if kind != "outage":
        return state, None
    if state is None:
        return (ts, 1), "ping1"
    start, level = state
    if level == 1 and ts - start >= second:
        return (start, 2), "ping2"
    if level == 2 and ts - start >= fallback:
        return (start, 3), "fallback"
    return state, None


def gap_step(state: tuple | None, ts: datetime, kind: str, window: timedelta = HOUR) -> tuple[tuple | None, str | None]:
    """A ping is suppressed while less than the window has passed since the last one sent; only sending re-arms."""
    if state is not None and ts - state[0] < window:
        return state, "suppressed"
    return (ts,), "sent"


def hold_step(state: tuple | None, ts: datetime, kind: str, cap: int = 6) -> tuple[tuple | None, str | None]:
    """Consecutive holds up to a cap, then a deferral; a success clears counts below the cap only."""
    n = state[0] if state else 0
    if kind == "held":
        return (n + 1,), "deferred" if n + 1 >= cap else "held"
    if kind == "published":
        return ((0,) if n < cap else (n,)), "published"
    return state, None


def strike_step(state: tuple | None, ts: datetime, kind: str, strikes: int = 3) -> tuple[tuple | None, str | None]:
    """The third failure of a link gives it up; a success forgets."""
    n = state[0] if state else 0
    if kind == "failed":
        return (n + 1,), "dead" if n + 1 >= strikes else "retry"
    return None, "ok"


def streak_step(state: tuple | None, ts: datetime, kind: str, cap: int = 3) -> tuple[tuple | None, str | None]:
    """Failing days in a row of attempts: one per UTC day; a success resets; the cap retires the link."""
    if kind != "failed":
        return None, "reset" if state else None
    day = ts.date()
    n, last = state if state else (0, None)
    n += last is None or last < day
    return (n, day), "retired" if n >= cap else "failing"


def cooldown_step(state: tuple | None, ts: datetime, kind: str, limit: int = 5, pause: timedelta = HOUR) -> tuple[tuple | None, str | None]:
    """Consecutive 'too many requests' answers of a host pause it."""
    n, until = state if state else (0, None)
    if until is not None and ts < until:
        return state, "paused"
    if kind != "throttled":
        return (0, None), "ok"
    n += 1
    return ((0, ts + pause), "pause") if n >= limit else ((n, None), "throttled")


MACHINES: dict[str, Callable] = {
    "outage": outage_step, "gap": gap_step, "hold": hold_step, "strike": strike_step, "streak": streak_step, "cooldown": cooldown_step,
}


@dataclass
class OutageSummary:
    """A recovery makes the stretch forget; without one, the last two outage events decide how far an earlier start has come."""

    second: timedelta = HOUR
    fallback: timedelta = 2 * HOUR
    forgets: bool = False
    fresh: tuple | None = None
    last: datetime | None = None
    before: datetime | None = None

    def add(self, ts: datetime, kind: str) -> None:
        self.forgets |= kind == "recovery"
        self.fresh = outage_step(self.fresh, ts, kind, self.second, self.fallback)[0]
        if kind == "outage":
            self.last, self.before = ts, self.last

    def after(self, state: tuple | None) -> tuple | None:
        if state is None or self.forgets or self.last is None:
            return self.fresh if state is None or self.forgets else state
        start, level = state
        if level == 1 and self.last - start >= self.second:
            # the first event after an hour takes the second step, only a later one the third
            level = 2 + (self.before is not None and self.before - start >= self.second and self.last - start >= self.fallback)
        elif level == 2 and self.last - start >= self.fallback:
            level = 3
        return start, level


@dataclass
class HoldSummary:
    """What becomes of each count below the cap; at the cap, holds only add."""

    cap: int = 6
    held: int = 0
    counts: list[int] | None = None

    def add(self, ts: datetime, kind: str) -> None:
        self.counts = [hold_step((n,), ts, kind, self.cap)[0][0] for n in self.counts or range(self.cap)]
        self.held += kind == "held"

    def after(self, state: tuple | None) -> tuple | None:
        n = state[0] if state else 0
        return (self.counts[n] if n < self.cap else n + self.held,)


@dataclass
class StrikeSummary:
    """Failures since the last success, which forgets what was before."""

    strikes: int = 3
    forgets: bool = False
    failed: int = 0

    def add(self, ts: datetime, kind: str) -> None:
        self.forgets |= kind != "failed"
        self.failed = self.failed + 1 if kind == "failed" else 0

    def after(self, state: tuple | None) -> tuple | None:
        n = self.failed + (0 if self.forgets or not state else state[0])
        return (n,) if n else None


@dataclass
class StreakSummary:
    """Days of failure since the last success, the first and the last of them."""

    cap: int = 3
    forgets: bool = False
    fresh: tuple | None = None
    first: date | None = None

    def add(self, ts: datetime, kind: str) -> None:
        self.forgets |= kind != "failed"
        self.fresh = streak_step(self.fresh, ts, kind, self.cap)[0]
        self.first = self.first or ts.date()

    def after(self, state: tuple | None) -> tuple | None:
        if state is None or self.forgets:
            return self.fresh
        n, last = self.fresh
        return state[0] + n - (self.first <= state[1]), last


SUMMARIES: dict[Callable, type] = {outage_step: OutageSummary, hold_step: HoldSummary, strike_step: StrikeSummary, streak_step: StreakSummary}


def fold(events: DataFrame, step: Callable, **options) -> DataFrame:
    """(key, ts, seq, output) of a machine over events (key, ts, seq, kind), per key in order of ts, then seq.

    A task holds one event and one state, however many events a key has. Events without a time are left out.
    """
    types = dict(events.dtypes)
    own = events.where("ts is not null").select("key", "ts", F.col("seq").cast("long").alias("seq"), "kind")
    order = ("key", "ts", "seq")
    begun_in: dict[int, tuple | None] = {}
    if step in SUMMARIES:
        ranges = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = kept(own.repartitionByRange(ranges, *order).sortWithinPartitions(*order))
        begun_in = _first_states(dealt, step, options)
    else:
        dealt = own.repartition("key").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = None
        begun, state = False, begun_in.get(TaskContext.get().partitionId())
        for batch in batches:
            out = []
            for key, ts, seq, kind in zip(*(batch.column(c).to_pylist() for c in (*order, "kind")), strict=True):
                if not begun:
                    current, begun = key, True
                elif key != current:
                    current, state = key, None
                state, said = step(state, ts.replace(tzinfo=None), kind, **options)
                if said is not None:
                    out.append((key, ts, seq, said))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field("key").type), pa.array(columns[1], batch.schema.field("ts").type), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
                    ["key", "ts", "seq", "output"],
                )

    return dealt.mapInArrow(run, f"key {types['key']}, ts {types['ts']}, seq long, output string")


def _first_states(dealt: DataFrame, step: Callable, options: dict) -> dict[int, tuple | None]:
    """The state in which the first key of each range begins: one small row a range comes to the driver."""
    summary_of = SUMMARIES[step]

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = summary = state = None
        begun = alone = False
        for batch in batches:
            for key, ts, kind in zip(*(batch.column(c).to_pylist() for c in ("key", "ts", "kind")), strict=True):
                if not begun:
                    first = last = key
                    begun, alone, summary = True, True, summary_of(**options)
                if alone and key == first:
                    summary.add(ts.replace(tzinfo=None), kind)
                    continue
                if key != last:
                    alone, last, state = False, key, None
                state = step(state, ts.replace(tzinfo=None), kind, **options)[0]
        if begun:
            said = pickle.dumps((first, summary, alone, last, state))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([said], pa.binary())], ["range", "said"])

    rows = sorted((r["range"], pickle.loads(r["said"])) for r in dealt.mapInArrow(summarised, "range int, said binary").collect())
    out: dict[int, tuple | None] = {}
    open_key, open_state, begun = None, None, False
    for place, (first, summary, alone, last, state) in rows:
        out[place] = open_state if begun and first == open_key else None
        open_key, open_state, begun = (first, summary.after(out[place]), True) if alone else (last, state, True)
    return out


def once_per_day(events: DataFrame) -> DataFrame:
    """Events (key, ts, seq) with sent: only the first of a key in each UTC day. A window does it, no machine."""
    day = Window.partitionBy("key", F.to_date("ts")).orderBy("ts", "seq")
    return events.withColumn("sent", F.row_number().over(day) == 1)


def failing_streaks(attempts: DataFrame, cap: int = 3) -> DataFrame:
    """(key, runs): failing days since the last success of (key, ts, ok), and whether the cap is reached."""
    last_ok = attempts.groupBy("key").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"))
    days = attempts.where("not ok").join(last_ok, "key").where("last_ok is null or ts > last_ok").groupBy("key").agg(F.count_distinct(F.to_date("ts")).alias("days"))
    return days.withColumn("retired", F.col("days") >= cap)


def slot_loop(queue: list[tuple], slots: list[datetime], outcome: Callable[[tuple, datetime], str]) -> list[tuple]:
    """The publishing day: per slot the head of the queue; a deferral ends the day, other outcomes move on.

    ``queue`` is the publishable head in order, as long as there are slots. Returns (slot, row, outcome).
    """
    rest, done = list(queue), []
    for slot in slots:
        if not rest:
            break
        row = rest[0]
        what = outcome(row, slot)
        done.append((slot, row, what))
        if what == "deferred":
            break
        if what in ("published", "failed"):
            rest.pop(0)
    return done


def retries(outcomes: list[str], limit: int = 4, wait: timedelta = timedelta(minutes=10)) -> tuple[str, timedelta]:
    """Attempt a publication again after transient errors only; the result and the time it took."""
    for i, what in enumerate(outcomes[: limit + 1]):
        if what != "transient" or i == min(limit, len(outcomes) - 1):
            return what, i * wait
    return "transient", limit * wait


def guard_until(last: datetime | None, now: datetime, gap: timedelta = timedelta(minutes=90)) -> datetime:
    """When publishing may go on after a restart: a gap after the last publication."""
    return now if last is None else max(now, last + gap)


def same_day_suppressed(marker: date | None, today: date) -> bool:
    """A daily ping is suppressed only by a marker of today; past, future and missing markers let it go."""
    return marker == today
