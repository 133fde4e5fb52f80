"""Functions over ordered series: lags, rolling frames and exponential averages, all as built-in window expressions.

A series is the rows of one key in the order of one column. Nulls are missing values; NaN should be turned into null
first (``clean``). Rolling functions are null until their frame holds ``least`` values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a block of an exponential average, at most; blocks are joined by their carry. Near alpha 1 they are shorter:
#: weights within a block don't fall below ``LEAST_WEIGHT``, so that their inverses stay exact enough.
BLOCK_ROWS, LEAST_WEIGHT = 64, 1e-150
#: What a carry from further back would add at most, as a share.
NEGLIGIBLE = 1e-18


def ordered(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def clean(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def frame(w: WindowSpec, n: int) -> WindowSpec:
    """The last n rows."""
    return w.rowsBetween(-(n - 1), 0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and null where b is zero."""
    return F.try_divide(a, b)


def change(c: Column, w: WindowSpec, k: int = 1) -> Column:
    """Relative change over k rows; null after a zero."""
    return ratio(c, F.lag(c, k).over(w)) - 1


def log_change(c: Column, w: WindowSpec, k: int = 1) -> Column:
    """Logarithm of the change over k rows; null where either end is not positive."""
    before = F.lag(c, k).over(w)
    return F.when((c > 0) & (before > 0), F.log(ratio(c, before)))


def rolling(f, c: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """``f`` over the last n rows, where at least ``least`` (all, by default) values are present."""
    at = frame(w, n)
    return F.when(F.count(c).over(at) >= (n if least is None else least), f(c).over(at))


def rolling_mean(c: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return rolling(F.avg, c, w, n, least)


def rolling_deviation(c: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return rolling(F.stddev_samp, c, w, n, least)


def rolling_volatility(c: Column, w: WindowSpec, n: int = 21, annualise: bool = True, days: int = 252) -> Column:
    """Deviation of returns over n rows, of which half, and five, must be there."""
    return rolling_deviation(c, w, n, max(n // 2, 5)) * (math.sqrt(days) if annualise else 1.0)


def rolling_quantile(c: Column, w: WindowSpec, n: int, share: float, least: int | None = None) -> Column:
    """The exact, interpolated percentile of the last n values."""
    return rolling(lambda x: F.percentile(x, F.lit(share)), c, w, n, least)


def rolling_var(c: Column, w: WindowSpec, n: int = 252, confidence: float = 0.95, least: int | None = None) -> Column:
    """Historical value at risk: the loss at a percentile of the last n returns, of which half (by default) must be there."""
    return -rolling_quantile(c, w, n, 1 - confidence, n // 2 if least is None else least)


def rolling_cvar(c: Column, w: WindowSpec, n: int = 252, confidence: float = 0.95) -> Column:
    """The mean loss among the last n returns at or below the percentile."""
    at = frame(w, n)
    limit = F.percentile(c, F.lit(1 - confidence)).over(at)
    tail = F.filter(F.collect_list(c).over(at), lambda x: x <= limit)
    mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)
    return F.when(F.count(c).over(at) >= n // 2, -mean)


def ema(df: DataFrame, columns: dict[str, tuple[str, float]], keys: list[str], order: str) -> DataFrame:
    """Adds exponential averages ``{name: (column, alpha)}``: y = alpha x + (1 - alpha) y before, from the first value on.

    A first-order recurrence is split into blocks of rows: within a block it is a running sum with weights, and what a
    block takes over from those before is a sum over their ends, of which only so many matter as the weights allow. So
    no series is folded row by row; its rows are numbered and summed in the task of its key. Nulls before the first
    value are skipped; nulls after it must not occur (fill them first).
    """
    w = ordered(keys, order)
    if any(not 0 < alpha <= 1 for _, alpha in columns.values()):
        raise ValueError("alpha must be above 0 and at most 1")
    out = df.withColumns({name: F.col(c) for name, (c, alpha) in columns.items() if alpha == 1})
    for column in dict.fromkeys(c for c, alpha in columns.values() if alpha < 1):
        # All averages of one column share its blocks, and one join.
        keeps = {name: 1 - alpha for name, (c, alpha) in columns.items() if c == column and alpha < 1}
        size = max(1, min(BLOCK_ROWS, *(math.floor(math.log(LEAST_WEIGHT) / math.log(keep)) for keep in keeps.values())))
        x = F.col(column)
        out = out.withColumn("_n", F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        out = out.withColumns({"_b": F.floor(F.col("_n") / size), "_j": F.col("_n") % size})
        inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

        def within(keep: float, x: Column = x, inside: WindowSpec = inside) -> Column:
            drive = F.when(F.col("_n") == 0, x).otherwise((1 - keep) * x)
            return F.when(x.isNotNull(), F.sum(drive * F.pow(F.lit(keep), -F.col("_j"))).over(inside) * F.pow(F.lit(keep), F.col("_j")))

        out = out.withColumns({f"_y_{name}": within(keep) for name, keep in keeps.items()})
        ends = out.where((F.col("_j") == size - 1) & x.isNotNull()).select(*keys, (F.col("_b") + 1).alias("_b"), *[f"_y_{name}" for name in keeps])

        def carry(name: str, keep: float, size: int = size) -> Column:
            back = max(1, math.ceil(math.log(NEGLIGIBLE) / (size * math.log(keep))))
            before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(-(back - 1), 0)
            return F.aggregate(F.collect_list(f"_y_{name}").over(before), F.lit(0.0), lambda a, y: a * keep**size + y)

        ends = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), *[carry(name, keep).alias(f"_c_{name}") for name, keep in keeps.items()])
        same = F.col("_b") == F.col("_kb")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        joined = out.join(ends, same, "left")
        out = joined.withColumns({name: F.col(f"_y_{name}") + F.coalesce(F.col(f"_c_{name}"), F.lit(0.0)) * F.pow(F.lit(keep), F.col("_j") + 1) for name, keep in keeps.items()})
        out = out.drop("_n", "_b", "_j", "_kb", *[f"_k_{k}" for k in keys], *[f"_{t}_{name}" for t in "yc" for name in keeps])
    return out


def span_alpha(span: int) -> float:
    return 2 / (span + 1)


def true_range(w: WindowSpec, high: str = "high", low: str = "low", close: str = "close") -> Column:
    """The greatest of high - low and the distances of both from the close before; the first row has high - low."""
    before = F.lag(close).over(w)
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def with_atr(df: DataFrame, n: int, keys: list[str], order: str, name: str = "atr") -> DataFrame:
    """Adds the exponential average (span n) of the true range."""
    made = df.withColumn("_tr", true_range(ordered(keys, order)))
    return ema(made, {name: ("_tr", span_alpha(n))}, keys, order).drop("_tr")


def with_rsi(df: DataFrame, n: int, keys: list[str], order: str, close: str = "close", name: str = "rsi") -> DataFrame:
    """Adds the relative strength index with Wilder's averages (alpha 1/n); null where no loss has been seen."""
    w = ordered(keys, order)
    delta = F.col(close) - F.lag(close).over(w)
    made = df.withColumn("_up", F.greatest(delta, F.lit(0.0))).withColumn("_down", F.greatest(-delta, F.lit(0.0)))
    made = made.withColumn("_up", F.when(delta.isNotNull(), F.col("_up"))).withColumn("_down", F.when(delta.isNotNull(), F.col("_down")))
    made = ema(made, {"_gain": ("_up", 1 / n), "_loss": ("_down", 1 / n)}, keys, order)
    strength = ratio(F.col("_gain"), F.col("_loss"))
    return made.withColumn(name, 100 - 100 / (1 + strength)).drop("_up", "_down", "_gain", "_loss")


def drawdown(c: Column, w: WindowSpec, n: int | None = None) -> Column:
    """Distance from the highest value so far, or of the last n rows, as a share of it."""
    top = F.max(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) if n is None else rolling(F.max, c, w, n)
    return ratio(c - top, top)


def lag_by(c: str, by: str, keys: list[str], most: int, at: str = "i") -> Column:
    """The value of a column ``by`` rows before, where ``by`` is a column too: a whole number from 1 to ``most``, the same in
    all rows of a series, whose rows ``at`` numbers without gaps. In the order of at / by that row lies 1 before."""
    slack = 0.25 / most
    series = ", ".join(f"`{k}`" for k in keys)
    return F.expr(f"first(`{c}`) OVER (PARTITION BY {series} ORDER BY `{at}` / `{by}` RANGE BETWEEN {1 + slack!r}D PRECEDING AND {1 - slack!r}D PRECEDING)")


def rolling_by(df: DataFrame, c: str, by: str, keys: list[str], most: int, mean: str, deviation: str, at: str = "i") -> DataFrame:
    """Adds mean and sample deviation of the last ``by`` rows (see ``lag_by``), null unless all of them have a value: two
    running sums, of which the ends are taken apart, so that any number of frame lengths takes one pass. Sums are of
    distances from the series' first value, which keeps them small."""
    w = Window.partitionBy(*keys).orderBy(at)
    every, so_far = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    made = df.withColumn("_x0", F.first(c, True).over(every)).withColumn("_x", F.col(c) - F.col("_x0"))
    made = made.withColumns({"_s1": F.coalesce(F.sum("_x").over(so_far), F.lit(0.0)), "_s2": F.coalesce(F.sum(F.col("_x") * F.col("_x")).over(so_far), F.lit(0.0)), "_c": F.count("_x").over(so_far)})
    made = made.withColumn("_ends", F.struct("_s1", "_s2", "_c")).withColumn("_before", lag_by("_ends", by, keys, most, at))
    back = lambda n: F.col(n) - F.coalesce(F.col("_before")[n], F.lit(0.0))
    n = F.col(by).cast("double")
    full = F.col("_c") - F.coalesce(F.col("_before")["_c"], F.lit(0)) == F.col(by)
    spread = F.when(n > 1, F.greatest(back("_s2") - back("_s1") * back("_s1") / n, F.lit(0.0)) / (n - 1))
    made = made.withColumns({mean: F.when(full, F.col("_x0") + back("_s1") / n), deviation: F.when(full, F.sqrt(spread))})
    return made.drop("_x0", "_x", "_s1", "_s2", "_c", "_ends", "_before")
