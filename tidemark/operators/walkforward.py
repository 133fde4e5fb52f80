"""Walk-forward validation: every window, symbol and parameter set is a run of one plan."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import WalkForwardError
from tidemark.operators import engine, metrics, strategies
from tidemark.plans.tables import kept

RUN = ["symbol", "window", "grid"]


def windows(bars: DataFrame, train: int = 252, test: int = 63, step: int = 21) -> DataFrame:
    """``symbol, window, train_from, test_from, test_to`` as places of bars (the last excluded) that fit each series."""
    if min(train, test, step) <= 0:
        raise WalkForwardError("window sizes must be positive")
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    last = F.floor((F.col("n") - train - test) / step).cast("int")
    out = n.where(F.col("n") >= train + test).select("symbol", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    return out.select("symbol", "window", (F.col("window") * step).alias("train_from"), (F.col("window") * step + train).alias("test_from"), (F.col("window") * step + train + test).alias("test_to"))


def _cut(bars: DataFrame, train: int, test: int, step: int, part: str, warm: int = 0) -> DataFrame:
    """Bars once for each window that has them in its train or test part, or in the ``warm`` bars before its test part. A
    bar's windows follow from its place, so no join over ranges is needed."""
    placed = strategies.numbered(bars, ["symbol"]).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    offset, length = (0, train) if part == "train" else (train - warm, test + warm)
    at = F.col("i") - offset
    first = F.greatest(F.lit(0), F.floor((at - length) / step) + 1).cast("int")
    last = F.least(F.floor(at / step), F.floor((F.col("_n") - train - test) / step)).cast("int")
    return placed.where((first <= last) & (F.col("_n") >= train + test)).withColumn("window", F.explode(F.sequence(first, last))).drop("i", "_n")


def grid(space: dict[str, list]) -> list[dict]:
    """All combinations, the last name varying fastest."""
    return [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]


def _runs(cut: DataFrame, strategy: str, params: list[dict], costs: engine.Costs, chosen: DataFrame | None = None, warm: int = 0) -> DataFrame:
    """Runs of all parameter sets on all windows or, with ``chosen``, of each window's set alone, in one plan. The first
    ``warm`` bars of a window give signals their history, and are not run."""
    if chosen is None:
        sets = cut.sparkSession.range(len(params)).select(F.col("id").cast("int").alias("grid"), F.lit(0).alias("_every"))
        rows = cut.withColumn("_every", F.lit(0)).join(F.broadcast(sets), "_every").drop("_every")  # one row a set, as listed
    else:
        rows = cut.join(chosen.select("symbol", "window", F.col("grid").cast("int").alias("grid")), ["symbol", "window"])
    if warm:
        rows = strategies.numbered(rows, RUN).withColumnRenamed("i", "_place")
    signals = strategies.grid_signals(rows, strategy, params, RUN)
    return engine.run(signals.where(F.col("_place") >= warm).drop("_place") if warm else signals, costs, RUN)


def select(bars: DataFrame, strategy: str, params: list[dict], *, train: int = 252, test: int = 63, step: int = 21, costs: engine.Costs = engine.Costs(), **options) -> DataFrame:  # noqa: B008
    """``symbol, window, grid, is_sharpe``: each window's best parameter set by Sharpe ratio over its train part. Of
    equals the first wins; a window in which no set gives a run takes the first, with a null ratio."""
    scored = metrics.sharpe(_runs(_cut(bars, train, test, step, "train"), strategy, params, costs), RUN, **options)
    best = scored.where(~F.isnan("sharpe_ratio")).groupBy("symbol", "window").agg(F.max(F.struct("sharpe_ratio", -F.col("grid"))).alias("_best"))
    out = windows(bars, train, test, step).select("symbol", "window").join(best, ["symbol", "window"], "left")
    return out.select("symbol", "window", F.coalesce(-F.col("_best.col2"), F.lit(0)).alias("grid"), F.col("_best.sharpe_ratio").alias("is_sharpe"))


def out_of_sample(bars: DataFrame, chosen: DataFrame, strategy: str, params: list[dict], *, train: int = 252, test: int = 63, step: int = 21, costs: engine.Costs = engine.Costs(), warm_start: bool = False) -> DataFrame:  # noqa: B008
    """Bars of each window's test part under its chosen set. Each part starts cold: what a strategy needs is taken from
    the part's own bars. With ``warm_start`` it is taken from the end of the train part, as far as that reaches, so that
    all bars of the test part are run; rules that follow a state begin it there. Windows may overlap; their rows are all kept,
    in the order of time and window."""
    warm = min(train, max(strategies.get(strategy, **p).needs() for p in params)) if warm_start else 0
    return _runs(_cut(bars, train, test, step, "test", warm), strategy, params, costs, chosen, warm)


def report(bars: DataFrame, strategy: str, space: dict[str, list], *, train: int = 252, test: int = 63, step: int = 21, costs: engine.Costs = engine.Costs(), warm_start: bool = False, **options) -> DataFrame:  # noqa: B008
    """One row for each symbol and window: chosen parameters (JSON), ratios in and out of sample, and test bars."""
    params = grid(space)
    chosen = kept(select(bars, strategy, params, train=train, test=test, step=step, costs=costs, **options))
    oos = out_of_sample(bars, chosen, strategy, params, train=train, test=test, step=step, costs=costs, warm_start=warm_start)
    tested = metrics.sharpe(oos, ["symbol", "window"], **options).select("symbol", "window", F.round("sharpe_ratio", 4).alias("oos_sharpe"), F.col("n_periods").alias("oos_n_bars"))
    text = F.element_at(F.array(*[F.lit(json.dumps(p, sort_keys=True)) for p in params]), F.col("grid") + 1)
    out = windows(bars, train, test, step).join(chosen, ["symbol", "window"]).join(tested, ["symbol", "window"], "left")
    return out.withColumn("best_params", text).withColumn("is_sharpe", F.round("is_sharpe", 4)).withColumn("oos_n_bars", F.coalesce("oos_n_bars", F.lit(0))).drop("grid")


def oos_metrics(oos: DataFrame, dedupe: bool = False, **options) -> DataFrame:
    """Metrics of each symbol's out-of-sample returns, one window after the other; with ``dedupe`` a time that several
    windows test counts once, as the first of them has it."""
    rows = oos.where("r is not null")
    if dedupe:
        rows = rows.groupBy("symbol", "ts").agg(F.min("window").alias("window"), F.min_by("r", "window").alias("r"))
    return metrics.compute(rows.withColumn("_at", F.struct("ts", "window")), ["symbol"], order="_at", **options)


def stability(reported: DataFrame, space: dict[str, list]) -> DataFrame:
    """``symbol, param, variation``: deviation over mean of each numeric parameter's chosen values."""
    numeric = [k for k, v in space.items() if isinstance(v[0], (int, float))]
    value = lambda k: F.get_json_object("best_params", f"$.{k}")
    as_number = lambda c: F.when(c == "true", F.lit(1.0)).when(c == "false", F.lit(0.0)).otherwise(c.try_cast("double"))
    rows = reported.select("symbol", F.explode(F.array(*[F.struct(F.lit(k).alias("param"), as_number(value(k)).alias("x")) for k in numeric])).alias("p")).select("symbol", "p.*")
    spread = F.when((F.count("x") < 2) | (F.avg("x") == 0), F.lit(0.0)).otherwise(F.round(F.stddev_pop("x") / F.abs(F.avg("x")), 4))
    return rows.groupBy("symbol", "param").agg(spread.alias("variation"))
