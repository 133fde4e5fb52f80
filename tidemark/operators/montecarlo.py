"""Monte Carlo paths of returns: block bootstrap or normal draws, for all series and scenarios in one job.

Draws come from integer arithmetic on (seed, scenario, path, block), so they don't depend on partitions or engines, and
whatever is multiplied or summed up for a path or a scenario is so in the order of its steps or values: results are equal
to the last bit however rows are dealt out.

A bootstrapped path is made of blocks of its history. Each place of a history carries the growth over the block that
begins there, so that a path takes one row for each block, not for each step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import SimulationError

MODULUS = 2147483647
#: Returns that a history needs.
SERIES_ROWS = 30
#: Places of all histories together up to which they are sent to all tasks; beyond, blocks are joined by shuffle.
BROADCAST_PLACES = 200_000
#: Places of a history whose sums are made in one row.
MOMENT_ROWS = 4096
KEY = "series_id"
# Reported percentiles of last values, and bands of a fan.
PERCENTILES = [5, 10, 25, 50, 75, 90, 95]
BANDS = [5, 25, 50, 75, 95]


@dataclass(frozen=True)
class Shock:
    """A stress: one more return in the history, and a factor for all others."""

    name: str = "unnamed_shock"
    return_shock: float = 0.0
    vol_multiplier: float = 1.0

    def __post_init__(self):
        if not -1 <= self.return_shock <= 0 or self.vol_multiplier <= 0:
            raise SimulationError("a shock lies between -1 and 0, and its multiplier above 0")


def draw(seed: int, *parts: Column) -> Column:
    """A whole number below MODULUS, from the parts (not negative) by congruential steps."""
    x = F.lit(seed % MODULUS).cast("long")
    for p in parts:
        x = (x * 48271 + p.cast("long") * 69621 + 12345) % MODULUS
    for _ in range(2):
        x = (x * 16807 + 7) % MODULUS
    return x


def histories(returns: DataFrame, shocks: list[Shock] = (), key: str = KEY) -> DataFrame:
    """``series_id, scenario, number, i, r, n``: each series' history, in order, of the baseline and of each shock, which
    comes first. A table without the key column is one series."""
    made = returns if key in returns.columns else returns.withColumn(key, F.lit(""))
    rows = made.where("r is not null").select(F.col(key).alias(KEY), "ts", "r")
    rows = rows.select(KEY, (F.row_number().over(Window.partitionBy(KEY).orderBy("ts")) - 1).alias("i"), "r")
    # One pass: each return goes to all scenarios, with the place and the factor that it has there.
    scenarios = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(k).alias("number"), F.lit(float(f)).alias("factor")) for k, (n, f) in enumerate([("baseline", 1.0), *((s.name or "unnamed_shock", s.vol_multiplier) for s in shocks)])])
    spread = rows.withColumn("s", F.explode(scenarios)).select(KEY, "s.scenario", "s.number", (F.col("i") + (F.col("s.number") > 0).cast("int")).alias("i"), (F.col("r") * F.col("s.factor")).alias("r"))
    if shocks:
        first = F.array(*[F.struct(F.lit(s.name or "unnamed_shock").alias("scenario"), F.lit(k).alias("number"), F.lit(float(s.return_shock)).alias("r")) for k, s in enumerate(shocks, 1)])
        begun = rows.where("i = 0").withColumn("s", F.explode(first)).select(KEY, "s.scenario", "s.number", F.lit(0).alias("i"), "s.r")
        spread = spread.unionByName(begun)
    return spread.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(KEY, "number")))


def moments(history: DataFrame) -> DataFrame:
    """``series_id, number, mean, deviation`` of each history, by blocks of places, which are then summed up in order."""
    total = lambda rows, f: F.aggregate(rows, F.lit(0.0), f)
    blocks = history.groupBy(KEY, "number", F.floor(F.col("i") / MOMENT_ROWS).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("x"))
    blocks = blocks.withColumn("sum", total("x", lambda a, x: a + x["r"])).withColumn("n", F.size("x"))
    blocks = blocks.withColumn("m2", total("x", lambda a, x: a + F.pow(x["r"] - F.col("sum") / F.col("n"), 2)))
    made = blocks.groupBy(KEY, "number").agg(F.sort_array(F.collect_list(F.struct("b", "n", "sum", "m2"))).alias("x"), F.sum("n").alias("n"))
    made = made.withColumn("mean", total("x", lambda a, x: a + x["sum"]) / F.col("n"))
    spread = total("x", lambda a, x: a + x["m2"] + x["n"] * F.pow(x["sum"] / x["n"] - F.col("mean"), 2))
    return made.select(KEY, "number", "mean", F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("deviation"))


def _facts(history: DataFrame, sims: int, horizon: int, block: int, method: str, least: int) -> tuple[DataFrame, int]:
    """``series_id, scenario, number, n, sim`` (parametric: also mean and deviation), dealt out by path, and the number of
    all places."""
    if sims < 1 or horizon < 1 or block < 1:
        raise SimulationError("paths, steps and blocks must be positive")
    if method not in ("bootstrap", "parametric"):
        raise SimulationError(f"unknown method {method!r}")
    facts = history.groupBy(KEY, "scenario", "number").agg(F.max("n").alias("n"))
    fewest, places = history.groupBy(KEY, "number").agg(F.max("n").alias("n")).agg(F.min("n"), F.sum("n")).first()
    if fewest is None or fewest < least:
        raise SimulationError(f"a history needs {least} returns")
    if method == "parametric":
        facts = facts.join(moments(history), [KEY, "number"])
    paths = facts.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long"))))
    return paths.repartition(KEY, "scenario", "sim"), places


def sampled(history: DataFrame, sims: int, horizon: int, *, method: str = "bootstrap", block: int = 10, seed: int = 42, least: int = SERIES_ROWS) -> DataFrame:
    """``series_id, scenario, sim, step, r`` (steps from 1). All series take the same draws, so that what they did at the
    same places of their histories goes together."""
    if method == "bootstrap":
        made = _drawn(history, sims, horizon, block, seed, least, "_returns")
        return made.select(KEY, "scenario", "sim", F.posexplode("steps").alias("_k", "r"), "_before").select(KEY, "scenario", "sim", (F.col("_before") + F.col("_k") + 1).alias("step"), "r")
    paths, _ = _facts(history, sims, horizon, block, method, least)
    paths = paths.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    u = lambda k: (draw(seed, F.col("number"), F.col("sim"), F.col("step"), F.lit(k)) + 1) / F.lit(float(MODULUS + 1))
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    return paths.select(KEY, "scenario", "sim", (F.col("step") + 1).alias("step"), (F.col("mean") + F.col("deviation") * normal).alias("r"))


def _size(n: Column, block: int) -> Column:
    return F.least(F.lit(block), F.floor(n / 4)).cast("int")


def placed(history: DataFrame, block: int = 10) -> DataFrame:
    """Each place of a history at which a block may begin, with the block's returns, ``_returns``, and the growth from its
    begin to each of its steps, ``_growth``."""
    ahead = Window.partitionBy(KEY, "number").orderBy("i").rowsBetween(0, block - 1)
    size = _size(F.col("n"), block)
    made = history.withColumn("_returns", F.slice(F.collect_list("r").over(ahead), 1, size)).where(F.col("i") <= F.col("n") - size)
    empty = F.array().cast("array<double>")
    growth = F.aggregate("_returns", empty, lambda a, r: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(1.0)) * (1 + r))))
    return made.select(KEY, "number", "i", "_returns", growth.alias("_growth"))


def _drawn(history: DataFrame, sims: int, horizon: int, block: int, seed: int, least: int, of: str) -> DataFrame:
    """``series_id, scenario, sim, part, steps, _before``: the blocks of all paths, the last cut at the horizon."""
    paths, places = _facts(history, sims, horizon, block, "bootstrap", least)
    size = _size(F.col("n"), block)
    parts = F.ceil(F.lit(horizon) / size).cast("int")
    paths = paths.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    paths = paths.withColumns({"i": (draw(seed, F.col("number"), F.col("sim"), F.col("part")) % (F.col("n") - size + 1)).cast("int"), "_before": F.col("part") * size, "_left": F.least(size, horizon - F.col("part") * size)})
    starts = placed(history, block).select(KEY, "number", "i", of)
    starts = F.broadcast(starts) if places <= BROADCAST_PLACES else starts
    return paths.join(starts, [KEY, "number", "i"]).select(KEY, "scenario", "sim", "part", F.slice(of, 1, F.col("_left")).alias("steps"), "_before")


def _ordered_product(at: str, factor: Column) -> Column:
    """The product of a group's factors, in the order of ``at``."""
    return F.aggregate(F.sort_array(F.collect_list(F.struct(F.col(at), factor.alias("f")))), F.lit(1.0), lambda a, x: a * x["f"])


def ends(history: DataFrame, sims: int, horizon: int, *, method: str = "bootstrap", block: int = 10, seed: int = 42, value: float = 1.0, least: int = SERIES_ROWS) -> DataFrame:
    """``series_id, scenario, sim, value``: the last value of each path that ``sampled`` would give, by blocks."""
    if method != "bootstrap":
        return terminals(sampled(history, sims, horizon, method=method, block=block, seed=seed, least=least), value)
    drawn = _drawn(history, sims, horizon, block, seed, least, "_growth")
    return drawn.groupBy(KEY, "scenario", "sim").agg((value * _ordered_product("part", F.element_at("steps", -1))).alias("value"))


def courses(history: DataFrame, sims: int, horizon: int, *, block: int = 10, seed: int = 42, value: float = 1.0, least: int = SERIES_ROWS) -> DataFrame:
    """``series_id, scenario, sim, step, value`` of bootstrapped paths, by blocks: ``paths`` of what ``sampled`` would give."""
    drawn = _drawn(history, sims, horizon, block, seed, least, "_growth")
    before = Window.partitionBy(KEY, "scenario", "sim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.product(F.element_at("steps", -1)).over(before), F.lit(1.0))
    made = drawn.withColumn("_base", base).select(KEY, "scenario", "sim", "_before", "_base", F.posexplode("steps").alias("_k", "_g"))
    return made.select(KEY, "scenario", "sim", (F.col("_before") + F.col("_k") + 1).alias("step"), (value * F.col("_base") * F.col("_g")).alias("value"))


def shocked(samples: DataFrame, shock: Shock) -> DataFrame:
    """Sampled returns with a shock on the paths themselves: the first step falls by it, all are scaled by its factor."""
    r = F.col("r") * shock.vol_multiplier
    return samples.withColumn("scenario", F.lit(shock.name)).withColumn("r", F.when(F.col("step") == 1, (1 + r) * (1 + shock.return_shock) - 1).otherwise(r))


def paths(samples: DataFrame, value: float = 1.0) -> DataFrame:
    """``series_id, scenario, sim, step, value``: the compounded value after each step."""
    w = Window.partitionBy(KEY, "scenario", "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return samples.select(KEY, "scenario", "sim", "step", (value * F.product(1 + F.col("r")).over(w)).alias("value"))


def terminals(samples: DataFrame, value: float = 1.0) -> DataFrame:
    """``series_id, scenario, sim, value``: each path's last value."""
    return samples.groupBy(KEY, "scenario", "sim").agg((value * _ordered_product("step", 1 + F.col("r"))).alias("value"))


def summary(ends: DataFrame, value: float = 1.0, confidences: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """For each series and scenario: paths, percentiles of the last value, and loss at risk and its mean beyond it. A
    scenario's last values, one a path, are sorted in one row."""
    gains = F.sort_array(F.collect_list(F.col("value") / value - 1))
    limits = {c: F.percentile(F.col("value") / value - 1, F.lit(round(1 - c, 6))) for c in confidences}
    made = ends.groupBy(KEY, "scenario").agg(
        F.count(F.lit(1)).alias("n_sims"),
        *[F.percentile("value", F.lit(p / 100)).alias(f"p{p}") for p in PERCENTILES],
        gains.alias("_g"),
        *[q.alias(f"_q{round(c * 100)}") for c, q in limits.items()],
    )

    def beyond(q: str) -> Column:
        tail = F.filter("_g", lambda x: x <= F.col(q))
        return F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)

    names = [round(c * 100) for c in confidences]
    return made.select(KEY, "scenario", "n_sims", *[f"p{p}" for p in PERCENTILES], *[(-F.col(f"_q{c}")).alias(f"var_{c}") for c in names], *[(-beyond(f"_q{c}")).alias(f"cvar_{c}") for c in names])


def fan(paths_: DataFrame) -> DataFrame:
    """Percentile bands of the value after each step."""
    return paths_.groupBy(KEY, "scenario", "step").agg(*[F.percentile("value", F.lit(p / 100)).alias(f"p{p}") for p in BANDS])
