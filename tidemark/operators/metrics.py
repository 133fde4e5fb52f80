"""Performance metrics of many return series at once: one grouped aggregation, and a projection of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import segments
from tidemark.operators import selection

# Names of the metrics.
NAMES = [
    "annualised_return", "annualised_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "hit_rate",
    "profit_factor", "skewness", "kurtosis", "var_95", "var_99", "cvar_95", "cvar_99", "n_periods",
]


def _inf() -> Column:
    return F.lit("Infinity").cast("double")


def with_quantiles(rows: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """Adds exact, interpolated percentiles of a column within each key: aggregated once (partly before the shuffle) and
    joined back; null keys are a key."""
    return joined(rows, rows.groupBy(*keys).agg(*[F.percentile(column, F.lit(q)).alias(name) for name, q in shares.items()]), keys)


def joined(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the facts of their key; null keys are a key."""
    facts = facts.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(facts, same, "left").drop(*[f"_k_{k}" for k in keys])


def _with_sharpe(sums: DataFrame, risk_free: float, days: int) -> DataFrame:
    """Adds yearly return, volatility and their ratio to counts (``n``), products (``growth``) and deviations."""
    n, zero = F.col("n").cast("double"), F.lit(0.0)
    ret = F.when((F.col("n") < 2) | (F.col("growth") <= 0), zero).otherwise(F.pow("growth", F.lit(float(days)) / n) - 1)
    vol = F.when(F.col("n") < 2, zero).otherwise(F.coalesce("deviation", zero) * days**0.5)
    out = sums.withColumn("annualised_return", F.coalesce(ret, zero)).withColumn("annualised_volatility", vol)
    over = F.col("annualised_return") - risk_free
    return out.withColumn("sharpe_ratio", F.when(F.col("annualised_volatility") == 0, zero).otherwise(over / F.col("annualised_volatility")))


def sharpe(series: DataFrame, keys: list[str], *, r: str = "r", risk_free: float = 0.04, days: int = 252) -> DataFrame:
    """``keys, n_periods, sharpe_ratio``, as ``compute`` has them, by one aggregation."""
    x = F.col(r)
    sums = series.groupBy(*keys).agg(F.count(x).alias("n"), F.product(1 + x).alias("growth"), F.stddev_samp(x).alias("deviation"))
    return _with_sharpe(sums, risk_free, days).select(*keys, F.col("n").alias("n_periods"), "sharpe_ratio")


def compute(series: DataFrame, keys: list[str], *, order: str = "ts", r: str = "r", equity: str | None = None, risk_free: float = 0.04, days: int = 252, segment: int | None = None) -> DataFrame:
    """All metrics (NAMES) of each key's returns ``r``; drawdown is that of ``equity``, or of the compounded returns.

    Null returns are left out. Metrics that too few returns or no variance leave open are 0; Sortino, Calmar and profit
    factor are infinite where there is gain and nothing to divide it by. Percentiles are exact and interpolated.
    ``segment``: for keys with more rows than a task should hold, the rows of a series that go to a task together;
    ``order`` may then be a list of columns.
    """
    quantiles = {f"_q{c}": round(1 - c / 100, 2) for c in (95, 99)}
    if segment is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        level = F.col(equity) if equity else F.product(1 + F.col(r)).over(w)
        made = series.withColumn("_level", level).withColumn("_top", F.max("_level").over(w))
        made = with_quantiles(made, keys, r, quantiles)
    else:
        at = [order] if isinstance(order, str) else list(order)
        made = series.select(*keys, *at, F.col(r), (F.col(equity) if equity else 1 + F.col(r)).alias("_level"))
        made = made if equity else segments.running(made, keys, at, {"_grown": ("product", "_level")}, segment).drop("_level").withColumnRenamed("_grown", "_level")
        made = segments.running(made, keys, at, {"_top": ("max", "_level")}, segment)
        made = joined(made, selection.quantiles(made, keys, r, quantiles, segment), keys)
    x = F.col(r)
    sums = made.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.product(1 + x).alias("growth"),
        F.stddev_samp(x).alias("deviation"),
        F.count_if(x < 0).alias("n_neg"),
        F.stddev_samp(F.when(x < 0, x)).alias("neg_deviation"),
        F.min(F.try_divide(F.col("_level") - F.col("_top"), F.col("_top"))).alias("max_drawdown"),
        F.avg((x > 0).cast("double")).alias("hit_rate"),
        F.sum(F.when(x > 0, x)).alias("gain"),
        F.sum(F.when(x < 0, -x)).alias("loss"),
        F.skewness(x).alias("g1"),
        F.kurtosis(x).alias("g2"),
        *[F.max(f"_q{c}").alias(f"q{c}") for c in (95, 99)],
        *[F.avg(F.when(x <= F.col(f"_q{c}"), x)).alias(f"tail{c}") for c in (95, 99)],
    )
    n = F.col("n").cast("double")
    zero = F.lit(0.0)
    out = _with_sharpe(sums, risk_free, days)
    over = F.col("annualised_return") - risk_free
    semi = F.coalesce("neg_deviation", zero)
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    kurt = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    more = {
        "sortino_ratio": F.when(F.col("n_neg") < 2, F.when(over > 0, _inf()).otherwise(zero)).when(semi == 0, zero).otherwise(over / (semi * days**0.5)),
        "max_drawdown": F.coalesce("max_drawdown", zero),
        "hit_rate": F.coalesce("hit_rate", zero),
        "profit_factor": F.when(F.coalesce("loss", zero) == 0, _inf()).otherwise(F.coalesce("gain", zero) / F.col("loss")),
        "skewness": F.when(n < 3, zero).otherwise(F.coalesce(skew, zero)),
        "kurtosis": F.when(n < 4, zero).otherwise(F.coalesce(F.when(~F.isnan("g2"), kurt), zero)),
        "n_periods": F.col("n"),
    }
    for c in (95, 99):
        more[f"var_{c}"] = F.coalesce(-F.col(f"q{c}"), zero)
        more[f"cvar_{c}"] = F.coalesce(-F.col(f"tail{c}"), -F.col(f"q{c}"), zero)
    out = out.withColumns(more)
    out = out.withColumn("calmar_ratio", F.when(F.col("max_drawdown") == 0, _inf()).otherwise(F.col("annualised_return") / F.abs("max_drawdown")))
    return out.select(*keys, *NAMES)


def drawdowns(series: DataFrame, keys: list[str], order: str = "ts", equity: str = "equity") -> DataFrame:
    """Adds each row's distance from the highest equity so far."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(equity).over(w)
    return series.withColumn("drawdown", F.try_divide(F.col(equity) - top, top))


def histogram(values: DataFrame, column: str, bins: int = 80) -> DataFrame:
    """Counts in equal bins between the least and greatest value: ``bin`` (from 1), ``lower`` and ``n``."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = values.join(F.broadcast(ends)).where(F.col(column).isNotNull())  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.lit(bins), F.floor((F.col(column) - F.col("lo")) / width) + 1)).cast("int")
    return at.groupBy(number.alias("bin")).agg(F.min(F.col("lo") + width * (number - 1)).alias("lower"), F.count(F.lit(1)).alias("n"))


def shares(values: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """Share of the rows that each value of a column has, within each key, to four places."""
    counts = values.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row for each value
    return counts.select(*keys, column, F.round(F.col("n") / F.sum("n").over(whole), 4).alias("share"))
