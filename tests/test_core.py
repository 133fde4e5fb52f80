"""Behaviour of bars, indicators, strategies, back-tests, risk, simulation and the store."""

import dataclasses
import json
import math
import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.functions import series
from tidemark.operators import bars, engine, features, metrics, montecarlo, risk, strategies, walkforward
from tidemark.plans.service import Service, Settings
from tidemark.sources import files
from tidemark.sources.store import Store
from tidemark.streaming import live

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def frame(n=300, seed=0, symbol="X"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.013, n)))
    open_ = close * (1 + rng.normal(0, 0.002, n))
    return pd.DataFrame({"symbol": symbol, "ts": pd.bdate_range("2018-01-01", periods=n), "open": open_, "high": np.maximum(open_, close) * 1.005, "low": np.minimum(open_, close) * 0.995, "close": close, "volume": 1e6})


@pytest.fixture(scope="module")
def made(spark):
    return spark.createDataFrame(frame(), BARS).cache()


def returns(spark, values, sid="a"):
    start = datetime(2020, 1, 1)
    return spark.createDataFrame([(sid, start + timedelta(days=i), float(v)) for i, v in enumerate(values)], "series_id string, ts timestamp_ntz, r double")


def valid(n=50):
    close = 100.0 + np.arange(n)
    return pd.DataFrame({"symbol": "X", "ts": pd.date_range("2022-01-01", periods=n), "open": close - 0.5, "high": close + 1, "low": close - 1, "close": close, "volume": 1e6})


def test_valid_bars_pass(spark):
    assert bars.checked(spark.createDataFrame(valid(), BARS)).count() == 50


@pytest.mark.parametrize(
    ("change", "words"),
    [
        (lambda d: pd.concat([d, d.tail(1)]), "duplicate"),
        (lambda d: d.assign(high=d.high.where(d.index != 5, d.low - 1)), "high too low"),
        (lambda d: d.assign(low=d.low.where(d.index != 5, d.high + 1)), "low too high"),
        (lambda d: d.assign(volume=d.volume.where(d.index != 5, -1.0)), "negative"),
    ],
)
def test_a_violation_is_named(spark, change, words):
    with pytest.raises(errors.DataIntegrityError, match=words):
        bars.checked(spark.createDataFrame(change(valid()), BARS))


def test_a_missing_column_is_named(spark):
    with pytest.raises(errors.DataIntegrityError, match="volume"):
        bars.checked(spark.createDataFrame(valid(), BARS).drop("volume"))


def test_jumps_are_counted_only(spark):
    d = valid()
    d.loc[20, ["open", "high", "low", "close"]] = [300.0, 301.0, 299.0, 300.0]
    assert bars.report(spark.createDataFrame(d, BARS)).first()["jumps"] == 2


def test_resampled_bars(spark):
    ticks = spark.createDataFrame([("X", datetime(2024, 1, 1, 9, m), float(m), m) for m in (1, 2, 59)] + [("X", datetime(2024, 1, 1, 10, 0), 7.0, 99)], "s string, t timestamp_ntz, p double, k long")
    rows = bars.from_ticks(ticks, "s", "t", "p", "k", "1h").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in rows] == [(1, 59, 1, 59, 62), (7, 7, 7, 7, 7)]
    week = bars.resample(bars.from_ticks(ticks, "s", "t", "p", "k", "1h"), "1w").first()
    assert (week.ts, week.open, week.close) == (datetime(2024, 1, 7), 1, 7)
    with pytest.raises(errors.ConfigurationError):
        bars.resample(ticks, "3h")


def test_fills(spark):
    d = valid(6).astype({"close": float})
    d.loc[[0, 3], "close"] = np.nan
    df = spark.createDataFrame(d, BARS).withColumn("close", series.clean(F.col("close")))
    close = lambda how: [r.close for r in bars.fill(df, how).orderBy("ts").collect()]
    assert close("ffill") == [101, 101, 102, 102, 104, 105]
    assert close("interpolate") == [101, 101, 102, 103, 104, 105]
    assert close("drop") == [101, 102, 104, 105]


def test_volume_alone_is_not_filled(spark):
    df = spark.createDataFrame(valid(3), BARS).withColumn("volume", F.when(F.col("ts") != F.lit("2022-01-02").cast("timestamp_ntz"), F.col("volume")))
    assert [r.volume for r in bars.fill(df).orderBy("ts").collect()] == [1e6, None, 1e6]


@pytest.mark.parametrize("alpha", [2 / 3, 2 / 21, 1 / 14, 2 / 401, 0.999999, 1 - 1e-200])
def test_exponential_average_equals_pandas(spark, alpha):
    d = frame(1000)
    want = d.close.ewm(alpha=alpha, adjust=False).mean()
    got = series.ema(spark.createDataFrame(d, BARS), {"y": ("close", alpha)}, ["symbol"], "ts").orderBy("ts").toPandas()["y"]
    assert np.allclose(got, want, rtol=1e-12)


def test_rolling_functions_equal_pandas(made):
    w = series.ordered(["symbol"], "ts")
    got = made.select("ts", series.rolling_deviation(F.col("close"), w, 20).alias("s"), series.rolling_var(F.col("close") / 1000, w, 60).alias("v"), series.rolling_cvar(F.col("close") / 1000, w, 60).alias("c")).orderBy("ts").toPandas()
    close = frame().close
    assert np.allclose(got.s, close.rolling(20).std(), equal_nan=True)
    assert np.allclose(got.v, -(close / 1000).rolling(60, min_periods=30).quantile(0.05), equal_nan=True)
    ok = got.v.notna()
    assert (got.c[ok] >= got.v[ok] - 1e-12).all()


def test_rsi_and_atr(made):
    d = frame()
    delta = d.close.diff()
    gain = delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    loss = (-delta).clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    got = series.with_rsi(made, 14, ["symbol"], "ts").orderBy("ts").toPandas()["rsi"]
    want = 100 - 100 / (1 + gain / loss.replace(0, np.nan))
    assert np.allclose(got[1:], want[1:], equal_nan=True)
    tr = pd.concat([d.high - d.low, (d.high - d.close.shift()).abs(), (d.low - d.close.shift()).abs()], axis=1).max(axis=1)
    got = series.with_atr(made, 14, ["symbol"], "ts").orderBy("ts").toPandas()["atr"]
    assert np.allclose(got, tr.ewm(span=14, adjust=False).mean())


def test_metrics_of_known_returns(spark):
    r = np.array([0.01, -0.02, 0.03, -0.01, 0.005, 0.02])
    m = metrics.compute(returns(spark, r), ["series_id"]).first()
    level = np.cumprod(1 + r)
    ann = level[-1] ** (252 / 6) - 1
    assert math.isclose(m.annualised_return, ann)
    assert math.isclose(m.annualised_volatility, r.std(ddof=1) * math.sqrt(252))
    assert math.isclose(m.sharpe_ratio, (ann - 0.04) / m.annualised_volatility)
    assert math.isclose(m.sortino_ratio, (ann - 0.04) / (r[r < 0].std(ddof=1) * math.sqrt(252)))
    assert math.isclose(m.max_drawdown, (level / np.maximum.accumulate(level) - 1).min())
    assert math.isclose(m.profit_factor, 0.065 / 0.03)
    assert math.isclose(m.var_95, -np.percentile(r, 5))
    assert m.cvar_95 >= m.var_95 and m.var_99 >= m.var_95 and m.n_periods == 6
    s = pd.Series(r)
    assert math.isclose(m.skewness, s.skew()) and math.isclose(m.kurtosis, s.kurt())


def test_metrics_of_odd_series(spark):
    up = metrics.compute(returns(spark, [0.01, 0.02, 0.01]), ["series_id"]).first()
    assert up.sortino_ratio == up.profit_factor == up.calmar_ratio == math.inf
    flat = metrics.compute(returns(spark, [0.0] * 10), ["series_id"]).first()
    assert (flat.sharpe_ratio, flat.annualised_volatility, flat.max_drawdown) == (0, 0, 0)
    one = metrics.compute(returns(spark, [0.01]), ["series_id"]).first()
    assert (one.annualised_return, one.annualised_volatility, one.skewness) == (0, 0, 0)
    assert metrics.compute(returns(spark, []), ["series_id"]).count() == 0


def pure_backtest(rows, costs):
    cash, qty, out = costs.capital, 0.0, []
    for direction, open_, close in rows:
        want = max((cash + qty * close) * costs.max_position / close * direction, 0) - qty
        if abs(want) >= 1e-6:
            if want > 0 and want * close * 1.001 > cash:
                want = cash * 0.99 / close
            price = open_ * (1 + math.copysign(costs.slippage, want))
            cash -= want * price + abs(want) * price * costs.commission + abs(want) * open_ * costs.slippage
            qty += want
            qty = 0.0 if abs(qty) < 1e-8 else qty
        out.append(cash + qty * close)
    return out


@pytest.mark.parametrize("name", strategies.names())
def test_backtest_equals_a_plain_loop(made, name):
    rule = strategies.get(name)
    signals = rule.signals(made).cache()
    got = engine.run(signals).orderBy("ts").toPandas()
    assert len(got) == 300 - rule.needs()
    rows = signals.orderBy("ts").select("direction", "open", "close").collect()
    assert np.allclose(got.equity, pure_backtest(rows, engine.Costs()))
    assert got.r.isna().sum() == 1 and np.allclose(got.r[1:], got.equity.pct_change()[1:])


def test_slippage_is_charged_twice_and_position_is_marked(spark):
    rows = [("X", datetime(2024, 1, d), 100.0, 101.0, 99.0, 100.0, 1.0, s) for d, s in ((1, 1), (2, 0))]
    df = spark.createDataFrame(rows, BARS + ", direction int")
    a, b = engine.run(df, engine.Costs(capital=1000.0, commission=0.0, slippage=0.01)).orderBy("ts").collect()
    assert math.isclose(a.qty, 2.5) and math.isclose(a.cash, 1000 - 2.5 * 101 - 2.5) and math.isclose(a.equity, a.cash + 250)
    assert b.qty == 0 and math.isclose(b.equity, b.cash)
    old = engine.run(df, engine.Costs(capital=1000.0, commission=0.0, slippage=0.01), semantics="reference").orderBy("ts").first()
    assert math.isclose(old.equity, old.cash)  # valued with the quantity that the position ends with


def test_fills_have_positive_quantities(made):
    rows = engine.fills(engine.run(strategies.get("momentum").signals(made)))
    assert rows.where("quantity <= 0").count() == 0 and rows.count() > 0


def test_strategy_parameters():
    with pytest.raises(errors.StrategyError):
        strategies.MovingAverageCrossover(50, 20)
    with pytest.raises(errors.StrategyError):
        strategies.MeanReversion(entry=0.5, exit=0.5)
    with pytest.raises(KeyError):
        strategies.get("none")
    with pytest.raises(TypeError):
        strategies.register("bad", int)
    assert strategies.get("momentum").with_params(lookback=5, other=1).lookback == 5


def test_beta_and_correlation(spark):
    rng = np.random.default_rng(1)
    b = rng.normal(0, 0.01, 200)
    a = 1.5 * b + rng.normal(0, 0.001, 200)
    bench = returns(spark, b).select("ts", F.col("r").alias("b"))
    ols, cov = (risk.beta(returns(spark, a), bench, method=m).first().beta for m in ("ols", "cov"))
    assert math.isclose(ols, cov) and 1.4 < ols < 1.6
    assert risk.beta(returns(spark, a[:5]), bench).first().beta is None
    both = returns(spark, a[:40], "a").union(returns(spark, b[:40], "b"))
    for method in ("pearson", "spearman", "kendall"):
        got = {(r.a, r.b): r.corr for r in risk.correlation(both, method).collect()}
        assert math.isclose(got["a", "a"], 1) and math.isclose(got["a", "b"], got["b", "a"])
    assert math.isclose(got["a", "b"], kendall(a[:40], b[:40]))
    assert risk.report(returns(spark, [0.1] * 4)).count() == 0


def test_correlations_by_tiles(spark, monkeypatch):
    """More series than a tile has, some that don't vary, over several tasks and blocks of times."""
    rng = np.random.default_rng(2)
    values = rng.normal(size=(11, 70))
    values[3] = 0.5 * values[0] + 0.1 * values[3]
    values[7] = 4.0
    rows = [(f"s{k:02d}", datetime(2024, 1, 1) + timedelta(i), float(x)) for k, row in enumerate(values) for i, x in enumerate(row)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, r double").repartition(5)
    monkeypatch.setattr(risk, "TIMES", 16)
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(values)
    for tile in (None, 4, 11, 1):
        got = {(r.a, r.b): r.corr for r in risk.products(df, "series_id", tile).collect()}
        assert len(got) == 121
        for i in range(11):
            for j in range(11):
                c = got[f"s{i:02d}", f"s{j:02d}"]
                assert (c is None) if 7 in (i, j) else math.isclose(c, want[i, j], abs_tol=1e-9), (i, j, tile)
    many = spark.range(300).select(F.concat(F.lit("k"), "id").alias("series_id"), F.explode(F.expr("sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-02-09', interval 1 day)")).alias("ts")).withColumn("r", (F.pmod(F.xxhash64("series_id", "ts"), F.lit(1000)) / 1000))
    made = risk.correlation(many)
    assert made.count() == 90_000 and made.where("a = b").agg(F.min("corr")).first()[0] > 0.999999


def kendall(x, y):
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))
    return s / (len(x) * (len(x) - 1) / 2)


def test_kendall_with_ties_and_ranges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    series_ = {"a": rng.integers(0, 9, 70), "b": rng.normal(size=70).round(1), "c": np.arange(70.0)}
    rows = returns(spark, series_["a"], "a").union(returns(spark, series_["b"], "b")).union(returns(spark, series_["c"], "c"))
    for size in (4096, 5):
        monkeypatch.setattr(risk, "RANGE_ROWS", size)
        made = risk.correlation(rows, "kendall")
        assert "collect_list" not in made._jdf.queryExecution().toString()
        got = {(r.a, r.b): r.corr for r in made.collect()}
        for x in series_:
            for y in series_:
                u, v = (np.sign(s[:, None] - s[None, :]) for s in (series_[x], series_[y]))
                assert math.isclose(got[x, y], (u * v).sum() / math.sqrt(abs(u).sum() * abs(v).sum()), abs_tol=1e-12)


def test_walk_forward(spark):
    df = spark.createDataFrame(frame(200), BARS)
    w = walkforward.windows(df, 100, 50, 25).orderBy("window").collect()
    assert [(r.train_from, r.test_from, r.test_to) for r in w] == [(0, 100, 150), (25, 125, 175), (50, 150, 200)]
    space = {"lookback": [5, 10], "vol_window": [5]}
    rows = walkforward.report(df, "momentum", space, train=100, test=50, step=25).orderBy("window").collect()
    assert len(rows) == 3 and all(json.loads(r.best_params)["lookback"] in (5, 10) for r in rows)
    assert {r.param for r in walkforward.stability(walkforward.report(df, "momentum", space, train=100, test=50, step=25), space).collect()} == set(space)
    short = walkforward.report(df, "momentum", {"lookback": [80], "vol_window": [5]}, train=100, test=50, step=25).collect()
    assert all(r.oos_n_bars == 0 and r.oos_sharpe is None for r in short)


GRIDS = {
    "ma_crossover": [{}, {"fast": 5, "slow": 12, "short": True}, {"fast": 3, "slow": 60}],
    "mean_reversion": [{}, {"lookback": 10, "entry": 1.5, "exit": 0.2, "short": False}, {"lookback": 7, "entry": 1, "exit": 0.5}],
    "momentum": [{}, {"lookback": 5, "vol_window": 9}, {"lookback": 20, "vol_window": 3, "short": False, "scaled": False}],
    "volatility_breakout": [{}, {"bands": 5, "width": 1, "atr": 30, "short": True}, {"bands": 33, "atr": 3}],
}


@pytest.mark.parametrize("name", sorted(GRIDS))
def test_a_grid_as_data_equals_its_sets(spark, name):
    bars_ = spark.createDataFrame(pd.concat([frame(130, 1, "X"), frame(90, 2, "Y"), frame(9, 3, "Z")]), BARS)
    rows = bars_.withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(2)))).repartition(3)
    got = {(r.symbol, r.grid, r.ts): r for r in strategies.grid_signals(rows, name, GRIDS[name], ["symbol", "grid"]).collect()}
    want = {(r.symbol, k, r.ts): r for k, p in enumerate(GRIDS[name]) for r in strategies.get(name, **p).signals(bars_).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k].direction == r.direction and (got[k].strength == r.strength or math.isclose(got[k].strength, r.strength, rel_tol=1e-6, abs_tol=1e-9)), k


def test_a_grid_of_any_size_has_one_plan(spark):
    bars_ = spark.createDataFrame(frame(200), BARS)
    plans = []
    for n in (2, 150):
        params = walkforward.grid({"lookback": list(range(3, 3 + n)), "vol_window": [5]})
        made = walkforward.select(bars_, "momentum", params, train=160, test=20, step=20)
        plans.append(len(made._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert plans[0] == plans[1]
    best = {r.window: r for r in made.collect()}
    cut = walkforward._cut(bars_, 160, 20, 20, "train")
    for k in (0, 77, 149):
        alone = engine.performance(engine.run(strategies.get("momentum", **params[k]).signals(cut, ["symbol", "window"]), keys=["symbol", "window"]), ["symbol", "window"])
        assert all(r.sharpe_ratio <= best[r.window].is_sharpe + 1e-9 for r in alone.collect())


def test_own_strategies_in_a_grid(spark):
    """A rule without a form of its own for grids is planned set by set."""

    @dataclasses.dataclass(frozen=True)
    class Always(strategies.Strategy):
        way: int = 1

        def needs(self):
            return 1

        def signals(self, bars, keys=strategies.KEYS):
            return bars.withColumn("direction", F.lit(self.way)).withColumn("strength", F.lit(1.0))

    strategies.register("always", Always)
    try:
        df = spark.createDataFrame(frame(60), BARS).withColumn("grid", F.explode(F.array(F.lit(0), F.lit(1))))
        got = strategies.grid_signals(df, "always", [{"way": 0}, {"way": 1}], ["symbol", "grid"])
        assert {(r.grid, r.direction) for r in got.collect()} == {(0, 0), (1, 1)} and got.count() == 120
    finally:
        strategies._known.pop("always")


def test_average_cost_and_unrealised_gain(spark):
    """Bought at two prices, sold in part, closed and opened again: figures by hand."""
    closes, ways = [100.0, 50.0, 200.0, 200.0, 80.0], [1, 1, 1, 0, 1]
    rows = [("X", datetime(2024, 1, 1) + timedelta(i), c, c, c, c, 1.0, w) for i, (c, w) in enumerate(zip(closes, ways))]
    df = spark.createDataFrame(rows, f"{BARS}, direction int")
    got = engine.run(df, engine.Costs(capital=1000.0, commission=0.0, slippage=0.0, max_position=0.5)).orderBy("ts").collect()
    # 5 at 100; equity 750: 7.5 wanted, 2.5 more at 50; equity 1875: 4.6875 wanted, 2.8125 sold; all sold; opened at 80.
    assert [round(r.qty, 6) for r in got] == [5, 7.5, 4.6875, 0, round(1875 * 0.5 / 80, 6)]
    average = (5 * 100 + 2.5 * 50) / 7.5
    assert [round(r.avg_cost, 6) for r in got] == [100, round(average, 6), round(average, 6), 0, 80]
    assert [round(r.unrealised, 6) for r in got] == [0, round(7.5 * (50 - average), 6), round(4.6875 * (200 - average), 6), 0, 0]


def test_monte_carlo(spark):
    rng = np.random.default_rng(0)
    history = returns(spark, rng.normal(0.0003, 0.015, 500)).select("ts", "r")
    two = returns(spark, rng.normal(0.0, 0.01, 80), "a").union(returns(spark, rng.normal(0.0, 0.03, 90), "b"))
    both = {r.series_id: r for r in montecarlo.summary(montecarlo.terminals(montecarlo.sampled(montecarlo.histories(two), 100, 30))).collect()}
    alone = montecarlo.summary(montecarlo.terminals(montecarlo.sampled(montecarlo.histories(two.where("series_id = 'b'")), 100, 30))).first()
    assert set(both) == {"a", "b"} and both["b"] == alone and both["b"].var_95 > both["a"].var_95
    sims = montecarlo.histories(history, [montecarlo.Shock("a", -0.1, 1.5), montecarlo.Shock("b", -0.2, 2.0)])
    rows = {r.scenario: r for r in montecarlo.summary(montecarlo.terminals(montecarlo.sampled(sims, 200, 40))).collect()}
    assert set(rows) == {"baseline", "a", "b"} and rows["a"].n_sims == 200
    for r in rows.values():
        assert r.p5 <= r.p50 <= r.p95 and r.cvar_95 >= r.var_95 and r.var_99 >= r.var_95
    again = montecarlo.summary(montecarlo.terminals(montecarlo.sampled(montecarlo.histories(history), 200, 40).repartition(7))).first()
    assert again == rows["baseline"]
    assert math.isclose(again.p50, rows["baseline"].p50)
    flat = montecarlo.summary(montecarlo.terminals(montecarlo.sampled(montecarlo.histories(history), 200, 40, method="parametric"))).first()
    assert 0.7 < flat.p50 < 1.3
    with pytest.raises(errors.SimulationError):
        montecarlo.sampled(montecarlo.histories(returns(spark, [0.1] * 5).select("ts", "r")), 10, 10)
    with pytest.raises(errors.SimulationError):
        montecarlo.Shock("x", 0.5)


def test_monte_carlo_is_equal_to_the_last_bit(spark, monkeypatch):
    """However rows are dealt out, by blocks or by steps, broadcast or shuffled, and from the formula itself."""
    rng = np.random.default_rng(4)
    two = returns(spark, rng.normal(0.001, 0.05, 90), "a").union(returns(spark, rng.normal(0.0, 0.03, 33), "b"))
    shocks = [montecarlo.Shock("crash", -1.0, 1.5)]
    sorted_ = lambda df: sorted(map(tuple, df.collect()))
    for method in ("bootstrap", "parametric"):
        history = montecarlo.histories(two, shocks)
        found = [sorted_(montecarlo.ends(history, 50, 37, method=method))]
        for parts, limit in ((1, 0), (3, 10**6), (13, 0)):
            monkeypatch.setattr(montecarlo, "BROADCAST_PLACES", limit)
            dealt = montecarlo.histories(two.repartition(parts), shocks)
            found.append(sorted_(montecarlo.ends(dealt.repartition(parts), 50, 37, method=method)))
            samples = montecarlo.sampled(dealt, 50, 37, method=method).repartition(parts)
            if method == "parametric":
                found.append(sorted_(montecarlo.terminals(samples)))
            else:
                steps = {r[:4]: r[4] for r in sorted_(montecarlo.courses(dealt, 50, 37))}
                by_step = {r[:4]: r[4] for r in sorted_(montecarlo.paths(samples))}
                assert steps.keys() == by_step.keys() and all(math.isclose(steps[k], v, rel_tol=1e-12, abs_tol=1e-15) for k, v in by_step.items())
            assert sorted_(montecarlo.summary(montecarlo.ends(dealt, 50, 37, method=method).repartition(parts))) == sorted_(montecarlo.summary(montecarlo.ends(history, 50, 37, method=method)))
        assert all(x == found[0] for x in found)
    plain = dict(enumerate([r.r for r in two.where("series_id = 'b'").orderBy("ts").collect()]))
    size, got = 33 // 4, {r.sim: r.value for r in montecarlo.ends(montecarlo.histories(two), 50, 37).where("series_id = 'b'").collect()}
    draws = {(r.sim, r.part): r.x for r in spark.range(50).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("part")).withColumn("x", montecarlo.draw(42, F.lit(0), F.col("sim"), F.col("part"))).collect()}
    for sim, value in got.items():
        want = 1.0
        for part in range(5):
            for k in range(min(size, 37 - part * size)):
                want *= 1 + plain[draws[sim, part] % (33 - size + 1) + k]
        assert math.isclose(value, want, rel_tol=1e-12)


def test_csv_folder(spark, tmp_path):
    valid(5).rename(columns={"ts": "Date", "close": "Adj Close", "volume": "Vol"}).drop(columns="symbol").to_csv(tmp_path / "abc.csv", index=False)
    valid(4).rename(columns={"ts": "timestamp"}).drop(columns="symbol").assign(extra="x").to_csv(tmp_path / "DEF.csv", index=False)
    source = files.CsvFolder(spark, str(tmp_path))
    assert source.symbols() == ["ABC", "DEF"] and isinstance(source, files.CsvFolder)
    assert source.fetch().count() == 9 and source.fetch(["abc"]).orderBy("ts").first().close == 100
    assert source.fetch(["abc"], "2022-01-02", "2022-01-03").count() == 2
    with pytest.raises(errors.IngestionError):
        source.fetch(["none"])
    (tmp_path / "odd.csv").write_text('date,open,high,low,close,volume\n2024-01-01,1,2,1,2,5\n2024-01-02,1,2,1,2\n2024-01-03,1,2,1,2,"5,000"\n"2024-01-04","1",2,1,2,7\n')
    assert [r.volume for r in source.fetch(["odd"]).orderBy("ts").collect()] == [5, None, None, 7]
    wide = [f"x{i}" for i in range(90)]
    (tmp_path / "wide.csv").write_text(",".join(["date", "open", "high", "low", "close", *wide, '"a ""quoted"", name"', "volume"]) + "\n" + ",".join(["2024-01-01", "1", "2", "1", "2", *["0"] * 90, '"1,2"', "77"]) + "\n")
    assert [r.volume for r in source.fetch(["wide"]).collect()] == [77]
    (tmp_path / "lacks.csv").write_text("date,close,volume\n2024-01-01,1,1\n")
    (tmp_path / "part.csv").write_text("date,open,high,close\n2024-01-01,1,1,1\n")
    assert {"LACKS", "PART", "WIDE"} <= set(source.symbols()) and source.fetch(["def", "abc"]).count() == 9
    with pytest.raises(errors.IngestionError, match="LACKS has no column timestamp|LACKS has no column open, high, low"):
        source.fetch(["lacks", "abc"])
    with pytest.raises(errors.IngestionError, match="PART has no column low, volume"):
        source.fetch(["part"])
    (tmp_path / "bad.csv").write_text("date,open,high,low,close,volume\nnever,1,1,1,1,1\n")
    with pytest.raises(errors.IngestionError, match="times"):
        source.fetch(["bad"])


def test_vendor_retries_and_errors(spark):
    body = json.dumps({"Meta": {}, "Time Series (Daily)": {"2024-01-02": {"1. open": "10", "2. high": "12", "3. low": "9", "4. close": "11", "5. adjusted close": "10.5", "6. volume": "100"}}})
    calls, waits = [], []

    def get(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return body

    row = files.VendorHttp(spark, "http://vendor.invalid", "k", get, waits.append).fetch(["abc"]).first()
    assert (row.symbol, row.close, row.volume) == ("ABC", 10.5, 100) and waits == [2.0, 4.0]
    with pytest.raises(errors.IngestionError, match="limit"):
        files.VendorHttp(spark, "u", "k", lambda _: '{"Note": "limit"}').fetch(["a"])
    with pytest.raises(errors.IngestionError):
        files.VendorHttp(spark, "u", "k", get).fetch(["a"], interval="3d")


def test_zero_prices_give_nulls_not_errors(spark):
    d = frame(200)
    d.loc[[70, 90], ["open", "low", "close"]] = 0.0
    df = spark.createDataFrame(d, BARS)
    w = series.ordered(["symbol"], "ts")
    got = df.select("ts", series.change(F.col("close"), w).alias("c"), series.log_change(F.col("close"), w).alias("l")).orderBy("ts").collect()
    assert got[71].c is None and got[70].l is None and got[71].l is None and got[70].c == -1
    built = features.build(df)
    assert 0 < built.count() < 200 and built.where("atr_pct is null").count() == 0
    for name in strategies.names():
        rows = engine.run(strategies.get(name).signals(df)).collect()
        assert rows and all(r.direction is not None and r.equity is not None for r in rows)
    flat = spark.createDataFrame(d.assign(open=0.0, high=0.0, low=0.0, close=0.0), BARS)
    assert features.build(flat).count() == 0 and engine.run(strategies.get("momentum").signals(flat)).where("traded != 0").count() == 0
    assert metrics.drawdowns(flat, ["symbol"], equity="close").where("drawdown is not null").count() == 0


def test_explainer(spark, made):
    rng = np.random.default_rng(3)
    n = 240
    values = {c: rng.normal(size=n) for c in features.NAMES}
    d = pd.DataFrame({"symbol": "X", "ts": pd.date_range("2020-01-01", periods=n), **values})
    signals = spark.createDataFrame(d[["symbol", "ts"]].assign(direction=np.sign(values["rsi_14"]).astype(int)), "symbol string, ts timestamp_ntz, direction int")
    table = spark.createDataFrame(d, "symbol string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in features.NAMES))
    model = features.Explainer(trees=5, folds=3).fit(table, signals, cross_validated=True)
    assert model.diagnostics["n_samples"] == n and model.diagnostics["train_accuracy"] > 0.95 and model.diagnostics["cv_accuracy_mean"] > 0.9
    rows = model.importance(repeats=4).collect()
    assert len(rows) == 16 and rows[0].feature == "rsi_14" and rows[0].importance_mean > 0.3 and rows[0].importance_std > 0
    assert all(abs(r.importance_mean) < 0.05 for r in rows[1:])
    with pytest.raises(errors.InsufficientDataError):
        features.Explainer(trees=1).fit(table.limit(20), signals)


def test_live_bars_and_portfolio(spark, tmp_path, made):
    rows = strategies.get("momentum", lookback=5, vol_window=5).signals(made).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "close", "direction").cache()
    cuts = [r.ts for r in rows.orderBy("ts").collect()]
    for i, (lo, hi) in enumerate(((0, 100), (100, len(cuts)))):
        rows.where(F.col("ts").between(cuts[lo], cuts[hi - 1])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/s{i}")
    for i in range(2):
        for f in (tmp_path / f"s{i}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = live.portfolio(stream).writeStream.format("memory").queryName("book").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination()
    want = engine.run(rows).orderBy("ts").toPandas()
    got = spark.table("book").orderBy("ts").toPandas()
    assert np.allclose(got.equity, want.equity)
    ticks = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = live.bars(ticks, "symbol", "ts", "close", "7 days").writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.table("weeks").orderBy("ts").collect()
    assert len(out) > 20 and all(r.low <= r.open <= r.high and r.low <= r.close <= r.high for r in out)


def test_a_live_strategy_equals_the_batch(spark, tmp_path):
    """Bars in any order within the lateness, over several micro-batches and symbols; those behind it don't count."""
    df = pd.concat([frame(150, 4, "X"), frame(120, 5, "Y")])
    rule = strategies.MovingAverageCrossover(3, 8, True)
    want = engine.run(rule.signals(spark.createDataFrame(df, BARS))).toPandas().sort_values(["symbol", "ts"])
    rng = np.random.default_rng(0)
    df["come"] = df["ts"] + pd.to_timedelta(rng.integers(0, 4, len(df)), "D")
    df = df.sort_values("come", kind="stable").drop(columns="come").reset_index(drop=True)
    end = df["ts"].max()
    last = pd.DataFrame([("Z", end + pd.Timedelta(days=d), 1.0, 1.0, 1.0, 1.0, 1.0) for d in (30, 60)], columns=df.columns)
    behind = df.iloc[:1].assign(ts=df["ts"].min() - pd.Timedelta(days=3), close=1e9)
    parts = [*(df.iloc[k : k + 45] for k in range(0, len(df), 45)), pd.concat([last.iloc[:1], behind]), last.iloc[1:]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, BARS).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p{k}")
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"p{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k:02d}-{f.name}")
            os.utime(tmp_path / "in" / f"{k:02d}-{f.name}", (1_700_000_000 + k, 1_700_000_000 + k))
    schema = BARS.replace("timestamp_ntz", "timestamp")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = live.crossover(stream, rule, late="5 days").writeStream.format("memory").queryName("crossings").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("crossings").where("symbol <> 'Z'").toPandas().sort_values(["symbol", "ts"])
    assert len(got) == len(want) and list(got.symbol) == list(want.symbol) and np.allclose(got.direction, want.direction) and np.allclose(got.equity, want.equity) and np.allclose(got.qty, want.qty)


def test_errors_of_the_service(spark, made):
    service = Service(Settings(n_sims=100, horizon=20))
    with pytest.raises(errors.InsufficientDataError):
        service.backtest(made.limit(20), "momentum")
    with pytest.raises(errors.WalkForwardError):
        service.walk_forward(made, "momentum", {"lookback": [5]})
    with pytest.raises(errors.SimulationError):
        Service(Settings(n_sims=99)).monte_carlo(returns(spark, [0.01] * 50))
    short = returns(spark, [0.01, 0.02, 0.03], "a")
    assert risk.report(short).count() == 0


def test_stored_runs_are_told_apart(spark, tmp_path, made):
    store = Store(spark, f"file://{tmp_path}")
    service = Service(Settings(n_sims=100, horizon=20, train=100, test=50, step=50), store)
    whole = service.backtest(made, "momentum", {"lookback": 20})
    part = service.backtest(made.orderBy("ts").limit(200), "momentum", {"lookback": 20})
    again = service.backtest(made.repartition(3), "momentum", {"lookback": 20})
    assert whole.run_id == again.run_id != part.run_id
    curve = store.table("equity_curve")
    assert curve.where(F.col("run_id") == whole.run_id).count() == whole.equity.count() and store.runs().count() == 2
    run = store.run(whole.run_id).first()
    assert (run.interval, run.capital) == ("1d", 100_000.0) and run.start_at < run.end_at
    joined = store.fills_of_runs()
    assert joined.count() == whole.fills.count() + part.fills.count() and {r.strategy for r in joined.collect()} == {"momentum"}
    store.delete_run(part.run_id)
    assert store.runs().count() == 1 and store.table("fills").where(F.col("run_id") == part.run_id).count() == 0
    service.backtest(made.orderBy("ts").limit(200), "momentum", {"lookback": 20})
    assert store.runs().count() == 2
    service.walk_forward(made, "momentum", {"lookback": [5, 10], "vol_window": [5]})
    rows = store.table("walkforward_runs").collect()
    assert len(rows) == 4 and {r.train for r in rows} == {100} and json.loads(rows[0].param_grid)["lookback"] == [5, 10]
    service.monte_carlo_of_run(whole.run_id, "X")
    found = store.table("montecarlo_runs").first()
    assert found.backtest_run_id == whole.run_id and found.n_sims == 100 and found.var_95 is not None


def test_store_and_service(spark, tmp_path, made):
    store = Store(spark, f"file://{tmp_path}")
    assert store.upsert_bars(made) == 300 and store.upsert_bars(made) == 0
    assert store.bars("X", "1d", "2018-01-01", "2018-01-05").count() == 5
    service = Service(Settings(n_sims=100, horizon=20), store)
    out = service.backtest(made, "momentum", {"lookback": 20})
    assert out.run_id == service.backtest(made, "momentum", {"lookback": 20}).run_id
    assert store.runs("momentum", limit=1).count() == 1
    assert service.monte_carlo_of_run(out.run_id, "X").count() == 1
    assert service.risk(out.run_id).count() == 1
    with pytest.raises(errors.StoreError):
        service.risk("none")
    store.delete_run(out.run_id)
    assert store.runs().count() == 0
    assert Settings.from_env({"TIDEMARK_CAPITAL": "5", "TIDEMARK_ALLOW_SHORT": "true"}).capital == 5
    with pytest.raises(errors.ConfigurationError):
        Settings.from_env({"TIDEMARK_CAPITAL": "x"})


def test_upsert_reads_what_the_new_bars_can_meet(spark, tmp_path):
    held = Store(spark, f"file://{tmp_path}")
    a = spark.createDataFrame(valid(20), BARS)
    b = a.withColumn("symbol", F.lit("OTHER"))
    assert held.upsert_bars(a.union(b)) == 40 and held.upsert_bars(a.union(b)) == 0 and held.upsert_bars(a, "1h") == 20
    late = a.where("ts >= timestamp_ntz '2022-01-15'").union(a.select("symbol", F.expr("ts + interval 100 days").alias("ts"), *[c for c in a.columns if c not in ("symbol", "ts")]))
    plan = held.held(late, "1d")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "interval" in filters.split("]")[0] and "symbol" in filters.split("PushedFilters")[0] and "GreaterThanOrEqual(ts" in filters
    assert held.upsert_bars(late) == 20 and held.table("ohlcv").count() == 80


def test_runs_of_two_intervals_are_two_runs(spark, tmp_path):
    held = Store(spark, f"file://{tmp_path}")
    df = spark.createDataFrame(frame(120), BARS)
    made = [Service(store=held).backtest(df, "momentum", interval=i) for i in ("1h", "1d", "1d")]
    assert made[0].run_id != made[1].run_id == made[2].run_id
    assert sorted(r.interval for r in held.runs().collect()) == ["1d", "1h"]
