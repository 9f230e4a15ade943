import random

import pytest
from pyspark.sql import functions as F

from cmdlode.operators.cooldown import apply_cooldown
from tests import naive
from tests.conftest import T0


def check(spark, times, fold_rows):
    """times: {key: [micros]}; repeats allowed."""
    base = int(T0.timestamp() * 1_000_000)
    rows = [(k, seq, base + t) for k, ts in times.items() for seq, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "tool string, seq bigint, us bigint").withColumn("ts", F.timestamp_micros("us"))
    got = apply_cooldown(df, ["tool"], fold_rows=fold_rows).collect()
    for key, ts in times.items():
        mine = sorted((r.us - base, r.seq) for r in got if r.tool == key)
        assert [t for t, _ in mine] == naive.cooldown(ts, 3_600_000_000)
        assert all(seq == ts.index(t) for t, seq in mine)


@pytest.mark.parametrize("fold_rows", [10_000, 0])
def test_minutes(spark, fold_rows):
    minute = 60_000_000
    check(
        spark,
        {"docker": [m * minute for m in (0, 10, 120)], "git": [11 * minute], "x": [m * minute for m in (0, 59, 60, 70, 121)]},
        fold_rows,
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_long_stretches_are_followed(spark, seed):
    rng = random.Random(seed)
    times = {}
    for key, step in (("dense", 200e6), ("medium", 2000e6), ("sparse", 9000e6)):
        at, ts = 0, []
        for _ in range(700):
            at += int(rng.expovariate(1 / step)) if rng.random() > 0.1 else 0
            ts.append(at)
        times[key] = ts
    times["even"] = [i * 590_000_000 for i in range(600)]
    check(spark, times, 0)
    check(spark, times, 50)


def test_nothing(spark):
    df = spark.createDataFrame([], "tool string, seq bigint, ts timestamp")
    assert apply_cooldown(df, ["tool"]).collect() == []
