"""Rolling order statistics and segmented windows against plain loops, for one long series and several short ones."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import orderstat, segments, series
from tidemark.functions.orderstat import Rolling
from tidemark.operators import metrics, selection

SCHEMA = "k string, at long, x double, note string"


def rows_of(key, values):
    return [(key, i, None if v is None or math.isnan(v) else float(v), f"n{i}") for i, v in enumerate(values)]


@pytest.fixture(scope="module")
def several(spark):
    rng = np.random.default_rng(8)
    long = rng.normal(size=700)
    long[rng.random(700) < 0.1] = np.nan
    data = {"a": long, "b": rng.integers(0, 4, 120).astype(float), "c": np.array([np.nan, 1.0]), None: rng.normal(size=30), "d": np.full(40, np.nan)}
    rows = [r for k, v in data.items() for r in rows_of(k, v)]
    return data, spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain(values, w):
    out = []
    for i in range(len(values)):
        frame = values[max(0, i - w.n + 1) : i + 1]
        frame = frame[~np.isnan(frame)]
        if len(frame) < max(w.least, 1):
            out.append(None)
            continue
        limit = np.percentile(frame, 100 * w.share)
        out.append(frame[frame <= limit + 1e-15].mean() if w.tail else limit)
    return out


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


@pytest.mark.parametrize("segment", [None, 64, 63])
def test_rolling_order_statistics(several, segment):
    data, df = several
    wanted = {"var": Rolling(63, 0.05, 30), "tail": Rolling(63, 0.05, 30, True), "median": Rolling(9, 0.5, 1), "most": Rolling(20, 1.0, 20), "least": Rolling(1, 0.0, 0)}
    got = orderstat.rolling(df, "x", wanted, ["k"], ["at"], segment)
    assert got.columns == [*df.columns, *wanted]
    found = {(r.k, r["at"]): r for r in got.collect()}
    assert len(found) == df.count()
    for k, values in data.items():
        for name, w in wanted.items():
            for i, want in enumerate(plain(values, w)):
                assert close(found[k, i][name], want), (k, i, name)


def test_order_statistics_over_many_batches(spark):
    """Frames over the cuts of Arrow batches, ties, and a frame longer than a batch."""
    rng = np.random.default_rng(2)
    values = rng.integers(-30, 30, 900) / 7
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        df = spark.createDataFrame(rows_of("a", values), SCHEMA)
        wanted = {"q": Rolling(130, 0.3, 65), "t": Rolling(130, 0.3, 65, True)}
        found = {r["at"]: r for r in orderstat.rolling(df, "x", wanted, ["k"], ["at"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, w in wanted.items():
        assert all(close(found[i][name], want) for i, want in enumerate(plain(values, w)))


def test_risk_of_frames_and_of_no_rows(spark, several):
    _, df = several
    with pytest.raises(ValueError):
        Rolling(0, 0.5, 1)
    with pytest.raises(ValueError):
        segments.overlapping(df.withColumn(segments.ROW, F.lit(0)), 5, 6)
    assert orderstat.with_risk(df.limit(0), "x", ["k"], ["at"], segment=300).count() == 0
    w = series.ordered(["k"], "at")
    old = {(r.k, r["at"]): r for r in df.select("k", "at", series.rolling_var(F.col("x"), w, 40, 0.95).alias("var"), series.rolling_cvar(F.col("x"), w, 40, 0.95).alias("cvar")).collect()}
    for r in orderstat.with_risk(df, "x", ["k"], ["at"], 40, 0.95).collect():
        assert close(r.var, old[r.k, r["at"]].var) and close(r.cvar, old[r.k, r["at"]].cvar)


def test_numbers_and_running_totals(several):
    data, df = several
    numbers = {(r.k, r["at"]): r[segments.ROW] for r in segments.numbered(df, ["k"], ["at"]).collect()}
    assert len(numbers) == df.count() and all(at == n for (_, at), n in numbers.items())
    wanted = {"total": ("sum", "x"), "n": ("count", "x"), "growth": ("product", "g"), "top": ("max", "x"), "low": ("min", "x"), "held": ("last", "x")}
    df = df.withColumn("g", 1 + F.col("x") / 100)
    for size in (7, 64, 10_000):
        got = {(r.k, r["at"]): r for r in segments.running(df, ["k"], ["at"], wanted, size).collect()}
        for k, values in data.items():
            s = pd.Series(values)
            want = {"total": s.cumsum().ffill(), "n": s.notna().cumsum(), "growth": (1 + s / 100).cumprod().ffill(), "top": s.cummax().ffill(), "low": s.cummin().ffill(), "held": s.ffill()}
            for name, col in want.items():
                assert all(close(got[k, i][name], None if pd.isna(v) else float(v)) for i, v in enumerate(col)), (name, k, size)


def test_one_series_in_segments_equals_one_task(spark):
    """One key: rolling frames, drawdown and exponential averages over many segments, which deal it out to many tasks."""
    values = 50 + np.cumsum(np.random.default_rng(1).normal(size=1000))
    df = spark.createDataFrame(rows_of("one", values), SCHEMA).repartition(4)
    w = series.ordered(["k"], "at")
    x = F.col("x")
    made = lambda w: {"mean": series.rolling_mean(x, w, 20), "dev": series.rolling_deviation(x, w, 20, 5), "fall": series.drawdown(x, w, 20), "step": series.change(x, w, 3)}
    whole = df.withColumns(made(w)).withColumn("down", series.drawdown(x, w))
    averages = {"e20": ("x", series.span_alpha(20)), "e500": ("x", series.span_alpha(500)), "fast": ("x", 0.9)}
    whole = {r["at"]: r for r in series.ema(whole, averages, ["k"], "at").collect()}
    for size in (20, 128):
        cut = segments.rolling(df, ["k"], ["at"], 19, made, size)
        assert cut.columns == [*df.columns, "mean", "dev", "fall", "step"]
        parts = cut.withColumn("p", F.spark_partition_id())
        rows = parts.collect()
        assert len(rows) == 1000 and all(close(r[c], whole[r["at"]][c]) for r in rows for c in ("mean", "dev", "fall", "step"))
        assert all(close(r.down, whole[r["at"]].down) for r in segments.drawdown(df, ["k"], ["at"], "x", "down", size).collect())
        assert all(close(r[c], whole[r["at"]][c]) for r in segments.ema(df, averages, ["k"], ["at"], size).collect() for c in averages)
    with pytest.raises(ValueError):
        segments.ema(df, {"y": ("x", 1.0)}, ["k"], ["at"])


def test_no_window_of_one_key_in_the_plan(spark):
    """Windows are over (key, segment), and those over a key alone see a row a segment."""
    df = spark.createDataFrame(rows_of("one", np.arange(200.0)), SCHEMA)
    plan = segments.rolling(df, ["k"], ["at"], 4, lambda w: {"m": series.rolling_mean(F.col("x"), w, 5)}, 16)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert any("_segment_" in line for line in windows) and all("_segment_" in line or "_n" in line for line in windows)


def test_exact_percentiles_by_narrowing_ranges(spark):
    rng = np.random.default_rng(3)
    data = {"wide": rng.standard_cauchy(4000), "ties": rng.integers(0, 3, 3000).astype(float), "one": np.array([2.5]), "same": np.full(900, 7.0), None: rng.exponential(size=1500), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([r for k, v in data.items() for r in rows_of(k, v)] + [("none", 0, None, "")], SCHEMA).repartition(6)
    shares = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for most, accuracy in ((100_000, 10_000), (40, 10_000), (3, 100)):
        got = {r.k: r for r in selection.quantiles(df, ["k"], "x", shares, most, accuracy).collect()}
        assert got.keys() == data.keys()
        for k, values in data.items():
            assert all(close(got[k][name], float(np.percentile(values, 100 * q))) for name, q in shares.items()), (k, most)
    assert selection.quantiles(df.limit(0), ["k"], "x", shares).count() == 0


def test_metrics_in_segments_equal_those_in_one_task(spark):
    rng = np.random.default_rng(6)
    rows = [r for k in ("a", "b") for r in rows_of(k, rng.normal(0.001, 0.02, 500))] + rows_of("c", [0.01]) + rows_of("d", [0.01, 0.02, 0.03, 0.04])
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r.k: r for r in metrics.compute(df, ["k"], order="at", r="x").collect()}
    for size in (64, 333):
        for r in metrics.compute(df, ["k"], order=["at"], r="x", segment=size).collect():
            assert all(close(r[c], whole[r.k][c]) or r[c] == whole[r.k][c] for c in metrics.NAMES), (r, whole[r.k])
    equity = df.withColumn("e", 100 + F.col("x"))
    a, b = (sorted(map(tuple, metrics.compute(equity, ["k"], order="at", r="x", equity="e", segment=s).select("k", F.round("max_drawdown", 9)).collect())) for s in (None, 50))
    assert a == b
