"""Spacing, resting URLs and resting hosts; batch and stream agree, and expired state is gone."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators import fetch_guard as g
from newsloom.operators import state as s
from newsloom.streaming import machines

T0 = datetime(2024, 1, 1)
SCHEMA = "host string, ts timestamp_ntz, seq long, url string, answer string"


def run(steps, **limits):
    state, out = None, []
    for minutes, url, answer in steps:
        state, said = g.guard_step(state, T0 + timedelta(minutes=minutes), f"{answer}|{url}", **limits)
        what, _, at = said.partition("@")
        out.append((what, (datetime.fromisoformat(at) - T0) / timedelta(minutes=1)))
    return out, state


def test_spacing_rests_and_forgetting():
    out, state = run([(0, "a", "ok"), (0.1, "b", "ok"), (0.1, "c", "refused"), (10, "c", "ok"), (11, "d", "timeout"), (24 * 60 + 0.5, "c", "ok"), (24 * 60 + 5, "c", "ok")])
    third = 2 / 3
    assert [w for w, _ in out] == ["answered", "answered", "refused", "url rests", "failed", "url rests", "answered"]
    assert [round(x, 6) for _, x in out[:3]] == [0, round(1 / 3, 6), round(third, 6)]
    assert round(out[3][1], 6) == round(24 * 60 + third, 6) and out[6][1] == 24 * 60 + 5
    assert state[3] == {} and state[1] == 0


def test_host_rests_after_refusals_in_a_row():
    steps = [(i, f"u{i}", "refused") for i in range(5)] + [(10, "x", "ok"), (70, "y", "refused"), (80, "z", "ok"), (140, "z", "ok"), (141, "q", "refused"), (142, "w", "ok")]
    assert [w for w, _ in run(steps)[0]] == ["refused"] * 4 + ["host refused", "host rests", "host refused", "host rests", "answered", "refused", "answered"]


def requests(n=400):
    rng = random.Random(3)
    at, out = T0, []
    for i in range(n):
        at += timedelta(seconds=rng.choice([1, 15, 400, 9000]))
        out.append((rng.choice(["p", "q", None]), at, i, f"u{rng.randrange(6)}", rng.choice(["ok", "refused", "refused", "gone", None])))
    return out


def test_table_follows_the_step(spark):
    rows = requests()
    got = {r.seq: (r.what, r.at) for r in g.guarded(spark.createDataFrame(rows, SCHEMA).repartition(4), refusals=2).collect()}
    states, want = {}, {}
    for host, ts, seq, url, answer in rows:
        states[host], said = g.guard_step(states.get(host), ts, f"{answer or ''}|{url}", refusals=2)
        what, _, at = said.partition("@")
        want[seq] = (what, datetime.fromisoformat(at))
    assert got == want and {w for w, _ in got.values()} == {*g.SKIPPED, *g.SENT}
    assert g.guarded(spark.createDataFrame([], SCHEMA)).count() == 0


def test_state_text_round_trip():
    state = (T0, 2, None, {"u": T0 + timedelta(hours=1)})
    assert machines.decode(machines.encode(state)) == state and machines.decode(machines.encode(None)) is None


def test_stream_agrees_and_forgets(spark, tmp_path):
    rows = [r for r in requests(120) if r[0]]
    end = rows[-1][1]
    rows += [("late", end + timedelta(days=9), 1000, "u", "ok"), ("late", end + timedelta(days=19), 1001, "u", "ok")]
    df = spark.createDataFrame(rows, SCHEMA).select(F.col("host").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "seq", g.event(F.col("answer"), F.col("url")).alias("kind"))
    df = df.orderBy("seq")
    for low, high in ((0, 60), (60, 999), (999, 1001), (1001, 1002)):
        df.where(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    out = machines.stream_machine(stream, g.guard_step, forget_after=timedelta(days=3), refusals=2)
    query = out.writeStream.format("memory").queryName("guard").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.seq: r.output for r in spark.table("guard").collect()}
    want = {r.seq: r.output for r in s.fold(df, g.guard_step, refusals=2).collect()}
    assert got == want
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in map(dict, query.recentProgress) if p["stateOperators"]]
    assert max(kept) >= 2 and kept[-1] == 1  # only the last host is still known
