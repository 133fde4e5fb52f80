"""Risk of return series: beta, correlations, and a report for many series at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import RiskError
from tidemark.operators import metrics
from tidemark.plans.tables import kept

BETA_ROWS, REPORT_ROWS = 10, 5
#: Series of a tile of a matrix of correlations, and times whose values are multiplied at once.
TILE, TIMES = 1024, 256
#: Ranges of a series' values, and ranks of a range of y.
RANGES, RANGE_ROWS = 64, 4096


def beta(returns: DataFrame, benchmark: DataFrame, keys: list[str] = ["series_id"], method: str = "ols") -> DataFrame:  # noqa: B006
    """``beta, alpha, r2, n`` of each series against ``benchmark (ts, b)`` over common times; null under ten of them."""
    if method not in ("ols", "cov"):
        raise RiskError(f"unknown method {method!r}")
    both = returns.join(benchmark.select("ts", "b"), "ts").dropna(subset=["r", "b"])
    slope = F.regr_slope("r", "b") if method == "ols" else F.covar_samp("r", "b") / F.nullif(F.var_samp("b"), F.lit(0.0))
    enough = lambda c: F.when(F.count(F.lit(1)) >= BETA_ROWS, c)
    return both.groupBy(*keys).agg(enough(slope).alias("beta"), enough(F.regr_intercept("r", "b")).alias("alpha"), enough(F.regr_r2("r", "b")).alias("r2"), F.count(F.lit(1)).alias("n"))


def aligned(returns: DataFrame, key: str = "series_id") -> DataFrame:
    """The rows at times at which every series has a value."""
    seen = returns.where("r is not null")
    n = seen.select(key).distinct().agg(F.count(F.lit(1)).alias("_all"))
    counted = seen.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ts")))
    return counted.join(F.broadcast(n), F.col("_n") == F.col("_all")).drop("_n", "_all")  # one row


def correlation(returns: DataFrame, method: str = "pearson", key: str = "series_id") -> DataFrame:
    """``a, b, corr`` for all pairs of series, over times that all of them have; null where a series doesn't vary. Spearman
    is Pearson of average ranks; Kendall is tau-b, over pairs of times, which are made by an equi-join on time."""
    rows = aligned(returns, key)
    if method == "spearman":
        w = Window.partitionBy(key)
        rows = rows.withColumn("r", F.rank().over(w.orderBy("r")) + (F.count(F.lit(1)).over(Window.partitionBy(key, "r")) - 1) / 2)
    elif method not in ("pearson", "kendall"):
        raise RiskError(f"unknown method {method!r}")
    return kendall_tau(rows, key) if method == "kendall" else products(rows, key)


def _tiles(size: int, times: int) -> Callable:
    """Sums of products of standard values of two tiles' series, over a task's times: rows come by pair of tiles and time."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, total, held, blocks = None, None, [], 0

        def add() -> None:
            nonlocal held
            at, side, number, z = (np.concatenate(x) for x in zip(*held, strict=True))
            _, row = np.unique(at, return_inverse=True)
            x = np.zeros((2, row.max() + 1, size))
            x[side, row, number] = z
            np.add(total, x[0].T @ x[1], out=total)
            held = []

        def made() -> pa.RecordBatch:
            if held:
                add()
            return pa.RecordBatch.from_pydict({"i": pa.array([pair[0]], pa.int32()), "j": pa.array([pair[1]], pa.int32()), "sums": [total.tobytes()]})

        for batch in batches:
            i, j, at, side, number, z = (c.to_numpy() for c in batch.columns)
            new = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (at[1:] != at[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(i)], strict=True):
                if hi == lo:
                    continue
                if pair != (i[lo], j[lo]):
                    if pair is not None:
                        yield made()
                    pair, total, blocks = (i[lo], j[lo]), np.zeros((size, size)), 0
                if not held or held[-1][0][0] != at[lo]:
                    blocks += 1
                    if blocks % times == 0 and held:
                        add()
                held.append((at[lo:hi], side[lo:hi], number[lo:hi], z[lo:hi]))
        if pair is not None:
            yield made()

    return multiply


def _added(size: int) -> Callable:
    def add(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_py()) for x in table.column("sums")).reshape(size, size)
        a, b = np.nonzero(np.ones_like(sums, bool))
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        return pa.table({"a": pa.array(i * size + a, pa.int64()), "b": pa.array(j * size + b, pa.int64()), "corr": sums.reshape(-1)})

    return add


def products(rows: DataFrame, key: str, tile: int | None = None) -> DataFrame:
    """``a, b, corr`` of series that have the same times, by tiles of a matrix: for each pair of tiles, tasks sum up products
    of standard values over their times (a product of matrices), and the tasks' tiles are summed up. So what is shuffled is a
    row for each value and tile it meets, and a tile for each task, not a row for each pair of series and time."""
    spark = rows.sparkSession
    facts = rows.groupBy(key).agg(F.avg("r").alias("_mean"), (F.var_pop("r") * F.count("r")).alias("_m2"))
    facts = kept(facts.withColumn("_id", F.row_number().over(Window.orderBy(key)) - 1))  # a row for each series
    n = facts.count()
    size = min(tile or TILE, max(1, n))
    last = max(0, n - 1) // size
    z = F.when(F.col("_m2") > 0, (F.col("r") - F.col("_mean")) / F.sqrt("_m2")).otherwise(F.lit(0.0))
    named = facts.withColumnRenamed(key, "_key")
    values = rows.join(named, rows[key].eqNullSafe(named["_key"])).select("ts", F.floor(F.col("_id") / size).cast("int").alias("tile"), (F.col("_id") % size).cast("int").alias("number"), z.alias("z"))
    # A value meets all tiles up from its own, and all before it; within its own it is on both sides.
    others = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j"), (t < F.col("tile")).cast("int").alias("side")))
    both = F.concat(others, F.array(F.struct(F.col("tile").alias("i"), F.col("tile").alias("j"), F.lit(1).alias("side"))))
    dealt = values.withColumn("p", F.explode(both)).select("p.i", "p.j", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "p.side", "number", "z")
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition("i", "j", F.pmod(F.xxhash64("at"), F.lit(slices))).sortWithinPartitions("i", "j", "at")
    sums = dealt.mapInArrow(_tiles(size, TIMES), "i int, j int, sums binary")
    made = sums.groupBy("i", "j").applyInArrow(_added(size), "a long, b long, corr double").where(F.greatest("a", "b") < n)
    # Tiles off the diagonal stand for their mirror as well.
    made = made.unionByName(made.where(F.floor(F.col("a") / size) != F.floor(F.col("b") / size)).select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    varies = facts.select("_id", key, (F.col("_m2") > 0).alias("_v"))
    for c in ("a", "b"):
        made = made.withColumnRenamed(c, "_id").join(varies, "_id").drop("_id").withColumnsRenamed({key: c, "_v": f"_v{c}"})
    return made.select("a", "b", F.when(F.col("_va") & F.col("_vb"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("corr")))).alias("corr"))


def dense_ranks(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``i``, the rank from 0 of ``r`` among its series' distinct values: by ranges of values and their totals."""
    values = rows.groupBy(key, "r").agg(F.count(F.lit(1)).alias("_n"))
    cuts = values.groupBy(key).agg(F.percentile_approx("r", [k / RANGES for k in range(1, RANGES)]).alias("_cuts"))
    dealt = values.join(cuts, key).select(key, "r", F.size(F.filter("_cuts", lambda c: c < F.col("r"))).alias("_range"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n")).select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy("r")) - 1
    ranks = dealt.withColumn("_in", inside).join(totals, [key, "_range"]).select(key, "r", (F.col("_base") + F.col("_in")).alias("i"))
    return rows.join(ranks, [key, "r"])


def kendall_tau(rows: DataFrame, key: str) -> DataFrame:
    """``a, b, corr``: tau-b of all pairs of series, in n log n rows. Two points that x tells apart part at one bit of
    their ranks in x; so at each bit, among ranks equal above it, those without it are counted against those with it
    and a lesser y, by running totals inside ranges of y and over the ranges."""
    ranks = kept(dense_ranks(rows, key).select("ts", F.col(key).alias("a"), "i"))
    cells = ranks.join(ranks.select("ts", F.col("a").alias("b"), F.col("i").alias("j")), "ts")
    cells = kept(cells.groupBy("a", "b", "i", "j").agg(F.count(F.lit(1)).alias("m")))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    tied = lambda by, name: cells.groupBy("a", "b", by).agg(F.sum("m").alias("m")).groupBy("a", "b").agg(two("m").alias(name))
    out = cells.groupBy("a", "b").agg((F.sum("m") * (F.sum("m") - 1) / 2).alias("all"), two("m").alias("xy")).join(tied("i", "tx"), ["a", "b"]).join(tied("j", "ty"), ["a", "b"])
    bits = int(ranks.agg(F.max("i")).first()[0] or 0).bit_length()
    by = ["a", "b", "bit", "above", "range"]
    at = cells.withColumn("bit", F.explode(F.array(*[F.lit(k) for k in range(max(1, bits))])))
    at = at.withColumns({"above": F.expr("shiftright(i, bit + 1)"), "has": F.expr("shiftright(i, bit) % 2 = 1"), "range": F.floor(F.col("j") / RANGE_ROWS)})
    side = at.groupBy(*by, "j").agg(F.sum(F.when(~F.col("has"), F.col("m")).otherwise(0)).alias("low"), F.sum(F.when(F.col("has"), F.col("m")).otherwise(0)).alias("high"))
    earlier = lambda w: F.coalesce(F.sum("high").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    side = side.withColumn("lesser", earlier(Window.partitionBy(*by).orderBy("j")))
    ranges = side.groupBy(*by).agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum(F.col("low") * F.col("lesser")).alias("inside"))
    ranges = ranges.withColumn("lesser", earlier(Window.partitionBy(*by[:-1]).orderBy("range")))
    crossed = ranges.groupBy("a", "b").agg(F.sum(F.col("inside") + F.col("low") * F.col("lesser")).alias("d"))
    free = F.sqrt((F.col("all") - F.col("tx")) * (F.col("all") - F.col("ty")))
    tau = (F.col("all") - F.col("tx") - F.col("ty") + F.col("xy") - 2 * F.col("d")) / F.nullif(free, F.lit(0.0))
    return out.join(crossed, ["a", "b"]).select("a", "b", tau.alias("corr"))


def matrix(correlations: DataFrame) -> DataFrame:
    """Correlations as one row for each series and a column for each."""
    return correlations.groupBy("a").pivot("b").agg(F.first("corr")).withColumnRenamed("a", "series")


def report(returns: DataFrame, benchmark: DataFrame | None = None, keys: list[str] = ["series_id"], **options) -> DataFrame:  # noqa: B006
    """Metrics of each series with five returns or more, with beta and correlation where a benchmark has enough."""
    seen = returns.where("r is not null")
    enough = seen.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") >= REPORT_ROWS).drop("_n")
    out = metrics.compute(enough, keys, **options)
    if benchmark is None:
        return out.withColumns({"beta": F.lit(None).cast("double"), "correlation": F.lit(None).cast("double")})
    both = enough.join(benchmark.select("ts", "b"), "ts").dropna(subset=["b"])
    pair = both.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= BETA_ROWS, F.regr_slope("r", "b")).alias("beta"), F.corr("r", "b").alias("correlation"))
    return out.join(pair, keys, "left")
