"""Machines over ranges of one key's events agree with one pass over all of them."""

import random
from datetime import datetime, timedelta

import pytest

from newsloom.operators import state as s

T0 = datetime(2024, 1, 1)
KINDS = {"outage": ("outage", "recovery", "other"), "hold": ("held", "published", "other"), "strike": ("failed", "ok"), "streak": ("failed", "ok")}


def events(name, n, rare, seed):
    rng = random.Random(seed)
    at = T0
    for _ in range(n):
        at += timedelta(minutes=rng.choice([0, 1, 20, 59, 60, 61, 300, 1500]))
        yield at, KINDS[name][0] if rng.random() > rare else rng.choice(KINDS[name])


@pytest.mark.parametrize("name", sorted(KINDS))
def test_summaries_take_any_state_where_the_steps_do(name):
    step = s.MACHINES[name]
    summary_of = s.SUMMARIES[step]
    for seed in range(300):
        rows = list(events(name, 40, random.Random(seed).choice([0, 0.05, 0.3]), seed))
        cut = seed % 35 + 1
        state = None
        for ts, kind in rows[:cut]:
            state, _ = step(state, ts, kind)
        for end in (cut + 1, cut + 2, 40):
            want, summary = state, summary_of()
            for ts, kind in rows[cut:end]:
                want, _ = step(want, ts, kind)
                summary.add(ts, kind)
            got = summary.after(state)
            assert got == want or (not want and not got) or (name == "hold" and (got or (0,)) == (want or (0,))), (seed, cut, end, state, got, want)


@pytest.mark.parametrize("name", sorted(KINDS))
def test_one_key_fills_all_tasks(spark, name):
    rows = [(7, ts, i, kind) for i, (ts, kind) in enumerate(events(name, 900, 0.05, 5))]
    rows += [(k, ts, i, kind) for k in (None, 1, 9) for i, (ts, kind) in enumerate(events(name, 30, 0.2, 6))]
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long, kind string").repartition(5)
    out = s.fold(df, s.MACHINES[name])
    got = out.withColumn("task", s.F.spark_partition_id()).collect()
    want, states = [], {}
    for key, ts, seq, kind in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        states[key], said = s.MACHINES[name](states.get(key), ts, kind)
        if said is not None:
            want.append((key, ts, seq, said))
    assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted(want, key=repr)
    assert len({r.task for r in got if r.key == 7}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_options_and_empty_tables(spark):
    rows = [(1, T0 + timedelta(days=i), i, "failed") for i in range(40)]
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long, kind string")
    assert [r.output for r in s.fold(df, s.streak_step, cap=30).orderBy("seq").collect()] == ["failing"] * 29 + ["retired"] * 11
    assert s.fold(df.limit(0), s.outage_step).count() == 0
