"""The state machines on streams, by applyInPandasWithState, and windowed counts with watermarks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_machine(events: DataFrame, step: Callable, forget_after: timedelta | None = None, **options) -> DataFrame:
    """(key, ts, seq, output) of a machine over a stream of (key, ts, seq, kind).

    Events of a key within one micro-batch are put in order of ts, then seq. The state is kept as JSON
    with times in ISO form; a key whose machine is back at its beginning keeps none. With ``forget_after`` (longer than any
    time that the machine counts) the stream needs a watermark on ts, and the state of a key goes when that time has passed without an event of it.
    """
    timeout = GroupStateTimeout.EventTimeTimeout if forget_after else GroupStateTimeout.NoTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        state = decode(group.get[0]) if group.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for ts, seq, kind in zip(rows["ts"], rows["seq"], rows["kind"], strict=True):
            state, said = step(state, ts.to_pydatetime(), kind, **options)
            if said is not None:
                out.append((key[0], ts, seq, said))
        if state is not None:
            group.update((encode(state),))
            if forget_after:
                due = int((rows["ts"].iloc[-1].to_pydatetime().replace(tzinfo=UTC) + forget_after).timestamp() * 1000)
                group.setTimeoutTimestamp(max(due, group.getCurrentWatermarkMs() + 1))
        elif group.exists:
            group.remove()
        yield pd.DataFrame(out, columns=["key", "ts", "seq", "output"])

    types = dict(events.dtypes)
    return events.groupBy("key").applyInPandasWithState(
        run, f"key {types['key']}, ts {types['ts']}, seq long, output string", "state string", "append", timeout
    )


def encode(state: tuple | None) -> str:
    """A machine's state as JSON, times and dates marked."""

    def one(x: object) -> list:
        if isinstance(x, dict):
            return ["m", {k: one(v) for k, v in x.items()}]
        return ["t", x.isoformat()] if isinstance(x, datetime) else ["d", x.isoformat()] if isinstance(x, date) else ["v", x]

    return json.dumps(None if state is None else [one(x) for x in state])


def decode(text: str) -> tuple | None:
    found = json.loads(text)

    def one(kind: str, v: object) -> object:
        if kind == "m":
            return {k: one(*x) for k, x in v.items()}
        return {"t": datetime.fromisoformat, "d": date.fromisoformat}.get(kind, lambda x: x)(v)

    return None if found is None else tuple(one(k, v) for k, v in found)


def windowed_counts(events: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Events per kind and window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n"))
