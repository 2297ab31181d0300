"""Requests to a host that may refuse them: spacing, a list of refused URLs, and a pause of the whole host.

Of each host it is remembered when the last request began, how many refusals came in a row, until when it is
left alone, and until when each refused URL is. The rules are one pure step, so that a table of past requests
(``guarded``) and a stream of them (newsloom.streaming.machines) follow the same ones. URLs whose time is
over are forgotten at the host's next request, and a host's state on a stream when all its times are over.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import state as s

# Times and counts of the guard.
SPACING = timedelta(seconds=20)
URL_REST = timedelta(hours=24)
HOST_REST = timedelta(hours=1)
REFUSALS = 5

#: What is said of a request that is not sent, and of one that is.
SKIPPED = ("host rests", "url rests")
SENT = ("answered", "failed", "refused", "host refused")


def event(answer: Column, url: Column) -> Column:
    """What a step reads of a request: its answer if it is sent (ok, refused, or anything else for a failure) and its URL."""
    return F.concat(F.coalesce(answer, F.lit("")), F.lit("|"), F.coalesce(url, F.lit("")))


def guard_step(
    state: tuple | None, ts: datetime, kind: str, spacing: timedelta = SPACING, url_rest: timedelta = URL_REST, host_rest: timedelta = HOST_REST, refusals: int = REFUSALS
) -> tuple[tuple | None, str | None]:
    """The state (last start, refusals in a row, host rests until, {url: rests until}) after a request, and ``what@start``.

    A sent request starts at least the spacing after the one before. A refusal puts its URL to rest, and from the given number in
    a row on the host too; an answer ends the row, another failure does not.
    """
    last, row, until, resting = state if state else (None, 0, None, {})
    answer, _, url = kind.partition("|")
    resting = {u: t for u, t in resting.items() if t > ts}
    if until is not None and ts < until:
        return (last, row, until, resting), f"host rests@{until.isoformat()}"
    if url in resting:
        return (last, row, None, resting), f"url rests@{resting[url].isoformat()}"
    start = ts if last is None else max(ts, last + spacing)
    until = None
    if answer == "ok":
        row, what = 0, "answered"
    elif answer == "refused":
        row, what = row + 1, "refused"
        resting = resting | {url: start + url_rest}
        if row >= refusals:
            until, what = start + host_rest, "host refused"
    else:
        what = "failed"
    return (start, row, until, resting), f"{what}@{start.isoformat()}"


def guarded(requests: DataFrame, **limits) -> DataFrame:
    """(host, ts, seq, what, at) of requests (host, ts, seq, url, answer) in order of ts, then seq.

    ``at`` is when a request is sent, or until when its host or URL rests.
    """
    types = dict(requests.dtypes)
    events = requests.select(F.col("host").alias("key"), "ts", "seq", event(F.col("answer"), F.col("url")).alias("kind"))
    said = s.fold(events, guard_step, **limits)
    parts = F.split("output", "@")
    return said.select(F.col("key").alias("host"), "ts", "seq", parts[0].alias("what"), parts[1].cast(types["ts"]).alias("at"))
