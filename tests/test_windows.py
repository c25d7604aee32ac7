"""Trailing windows, joins and order statistics against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.operators import features, joins, profile, quantile, timeline
from vigilog.session import pinned

BASE = 1704067200
# Ties, gaps of exactly 60, 300 and 301 seconds, an hour boundary and a missing time.
EDGES = [0, 0, 60, 120, 121, 421, 722, 3599, 3600, 3601, 3660, 3899, 3900, 3901, 7201, 20000, None]


def rows(seed=None, n=0):
    draw = random.Random(seed)
    offsets = EDGES if seed is None else [draw.randrange(12000) for _ in range(n)]
    result = []
    for i, offset in enumerate(offsets):
        result.append(
            (i, None if offset is None else BASE + offset, draw.choice([4624, 4625, 1, None]), draw.choice([1, 2, None]), draw.choice(["a", "b", None]))
        )
    return result


def brute(data):
    order = sorted((r for r in data if r[1] is not None), key=lambda r: (r[1], r[0]))
    expected = {}
    for place, (key, t, *_rest) in enumerate(order):
        window = [r for r in order if t - 300 <= r[1] <= t]
        logins = [r for r in window if r[2] in (4624, 4625)]
        gap = 0 if place == 0 else min(3600, t - order[place - 1][1])
        expected[key] = (
            gap,
            sum(t - 60 <= r[1] <= t for r in order),
            len({r[2] for r in window} - {None}),
            len({r[3] for r in window} - {None}),
            len({r[4] for r in window} - {None}),
            round(sum(r[2] == 4625 for r in logins) / len(logins), 9) if logins else 0.0,
        )
    expected.update({r[0]: (0, 0, 0, 0, 0, 0.0) for r in data if r[1] is None})
    return expected


def frame(spark, data):
    return spark.createDataFrame(data, "record_id long, EpochSeconds long, EventID long, ExecutionProcessID long, IP string")


@pytest.mark.parametrize("seed,parts", [(None, 1), (1, 1), (1, 7), (2, 3)])
def test_trailing_windows(spark, seed, parts):
    data = rows(seed, 400)
    log = frame(spark, data).repartition(parts)
    df = features.trailing_windows(log, pinned(profile.second_profile(log)))
    columns = ["TimeSincePrevEvent", "EventsPerMinute", "UniqueEventIDsInWindow", "UniqueProcessCount", "UniqueIPCount", "FailedLoginRatio"]
    found = {r["record_id"]: tuple(r[c] if c != "FailedLoginRatio" else round(r[c], 9) for c in columns) for r in df.collect()}
    assert found == brute(data)


@pytest.mark.parametrize("seed", [None, 5])
def test_event_context(spark, seed):
    data = rows(seed, 300)
    log = frame(spark, data)
    found = {
        r["record_id"]: (r["events_before"], r["events_after"], r["diversity"], r["occurrences"])
        for r in timeline.event_context(log, log).collect()
    }
    timed = [r for r in data if r[1] is not None]
    expected = {}
    for key, t, event, *_rest in timed:
        near = [r for r in timed if abs(r[1] - t) <= 600]
        expected[key] = (
            sum(r[1] < t for r in near), sum(r[1] > t for r in near), len({r[2] for r in near} - {None}),
            sum(r[2] == event for r in near) if event is not None else 0,
        )
    # Without a time nothing is known of the events around.
    expected |= {r[0]: (None, None, None, None) for r in data if r[1] is None}
    assert found == expected


def test_attach_splits_hot_keys(spark):
    keys = [1] * 500 + list(range(2, 60)) + [None]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "record_id long, k long")
    table = pinned(df.filter("k is not null").groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.col("k") * 10))
    small = joins.attach(df, table, "k", "w")
    large = joins.attach(df, table, "k", "w", broadcast_rows=0, hot_rows=50)
    assert sorted(map(tuple, small.select("record_id", "k", "v").collect())) == sorted(map(tuple, large.select("record_id", "k", "v").collect()))
    assert large.count() == len(keys)


def test_rows_without_a_key_are_spread(spark):
    """No task of the join holds most of the rows without a key."""
    df = spark.createDataFrame([(i, i if i % 10 < 3 else None) for i in range(4000)], "record_id long, k long")
    table = pinned(df.filter("k is not null").groupBy("k").agg(F.count("*").alias("w")))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = joins.attach(df, table, "k", "w", broadcast_rows=0)
        sizes = [r["n"] for r in joined.filter("k is null").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert sum(sizes) == 2800 and max(sizes) < 1400


@pytest.mark.parametrize("small", [5, 100_000])
def test_exact_quantiles(spark, small, monkeypatch):
    monkeypatch.setattr(quantile, "SMALL", small)
    monkeypatch.setattr(quantile, "BINS", 8)
    draw = np.random.default_rng(3)
    for values in (draw.normal(size=500), np.repeat([1.0, 2.0, 2.0, 7.0], 50), np.full(40, 3.5), 10.0 ** draw.uniform(-9, 9, 300)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
        for share in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert quantile.quantile(df, "x", share) == pytest.approx(np.quantile(values, share), rel=1e-12)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_event_runs_hold_every_listing_once(spark, seed):
    from vigilog.operators import timeline

    rng = random.Random(seed)
    times = [rng.choice([rng.randrange(0, 20_000), rng.randrange(90_000, 90_500), None]) for _ in range(150)] + [5_000] * 20
    rows = [(i, 1, t) for i, t in enumerate(times)]
    log = spark.createDataFrame(rows, "record_id long, EventID long, EpochSeconds long").repartition(3)
    chosen = {i for i, t in enumerate(times) if i % (4 * seed) == 0}
    found = timeline.event_runs(log, log.filter(F.col("record_id").isin(chosen)), minutes=2).collect()
    by_place = {r["place"]: r["record_id"] for r in found}
    assert len(by_place) == len(found) == len({r["record_id"] for r in found})
    for r in found:
        assert r["run_start"] <= r["EpochSeconds"] <= r["run_stop"]
        assert r["IsAnomalous"] == (r["record_id"] in chosen) and (r["first_place"] is None) != r["IsAnomalous"]
        if r["IsAnomalous"]:
            own = {by_place[p] for p in range(r["first_place"], r["last_place"] + 1)}
            assert own == {i for i, t in enumerate(times) if t is not None and abs(t - times[r["record_id"]]) <= 120}
    anomalies = {i for i in chosen if times[i] is not None}
    assert {r["record_id"] for r in found} == {i for i, t in enumerate(times) if t is not None and any(abs(t - times[j]) <= 120 for j in anomalies)}
    spans = sorted({(r["run_start"], r["run_stop"]) for r in found})
    assert all(b[0] - a[1] > 1 for a, b in zip(spans, spans[1:]))
