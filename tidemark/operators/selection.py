"""Exact percentiles of groups of any size, by ranges that narrow.

``percentile`` keeps all distinct values of a group in one task. Here each wanted place of a group's sorted values has a
range that holds it. A pass asks a sketch of bounded size for values before and after the place among the range's values,
and counts what lies below, between and above them, which gives the next range, some fifty times smaller. What
is left in the end, a bounded number of values a place, is sorted. Passes grow with the logarithm of the group's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.tables import kept

#: Rows of a range that are sorted; accuracy of the sketch, as the inverse of the share of rows that it may be off; passes.
MOST, ACCURACY, PASSES = 50_000, 10_000, 40
#: Cuts of a range in a pass: as many parts, of which the one that holds the place is the next range.
CUTS = 64
#: Places (two for each key and share) that are sent to all tasks; more are joined by shuffle.
BROADCAST_PLACES = 100_000


def _with(values: DataFrame, places: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Values with the places of their key whose range they lie in."""
    named = places.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = values.join(F.broadcast(named) if small else named, same & F.col("_x").between(F.col("_lo"), F.col("_hi")))
    return joined.drop(*[f"_k_{k}" for k in keys])


def quantiles(rows: DataFrame, keys: list[str], column: str, shares: dict[str, float], most: int = MOST, accuracy: int = ACCURACY) -> DataFrame:
    """``keys`` and the interpolated percentiles ``{name: share}`` of each key's values (nulls are passed over; null keys are
    a key). Equal to ``percentile`` for any size, with at most ``most`` values of a place in one task, or as many as are
    equal."""
    values = kept(rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_x")))
    place = lambda name, q: F.struct(F.lit(name).alias("_name"), ((F.col("_inside") - 1) * F.lit(float(q))).alias("_at"))
    whole = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_inside"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    wanted = kept(whole.withColumn("_p", F.explode(F.array(*[place(n, q) for n, q in shares.items()]))).select("*", "_p.*").drop("_p"))
    ends = F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))
    places = kept(wanted.select(*keys, "_lo", "_hi", "_inside", F.lit(0).cast("long").alias("_below"), F.explode(ends).alias("_place")).distinct())
    small = places.count() <= BROADCAST_PLACES
    at = [*keys, "_place"]
    for _ in range(PASSES):
        open_ = (F.col("_inside") > most) & (F.col("_lo") < F.col("_hi"))
        if places.where(open_).isEmpty():
            break
        inside = _with(values, places.where(open_), keys, small)
        share = F.try_divide(F.col("_place") - F.col("_below"), F.col("_inside") - 1)
        # The sketch gives a cut for each of some evenly spread shares; those around the place are its bracket.
        grid = [k / CUTS for k in range(CUTS + 1)]
        cuts = inside.groupBy(*at).agg(F.percentile_approx("_x", grid, accuracy).alias("_cuts"), F.first(share).alias("_share"))
        slack = 2.0 / accuracy
        left = F.greatest(F.lit(0), F.floor((F.col("_share") - slack) * CUTS)).cast("int")
        right = F.least(F.lit(CUTS), F.ceil((F.col("_share") + slack) * CUTS)).cast("int")
        cuts = kept(cuts.select(*at, F.get("_cuts", left).alias("_a"), F.get("_cuts", right).alias("_b")))
        ranged = places.where(open_).join(cuts.withColumnsRenamed({k: f"_j_{k}" for k in at}), _equal(at), "inner").drop(*[f"_j_{k}" for k in at])
        x = F.col("_x")
        counted = _with(values, ranged, keys, small).groupBy(*at, "_lo", "_hi", "_inside", "_below", "_a", "_b").agg(F.count_if(x < F.col("_a")).alias("_c1"), F.count_if(x == F.col("_a")).alias("_ca"), F.count_if(x.between(F.col("_a"), F.col("_b"))).alias("_c2"), F.count_if(x == F.col("_b")).alias("_cb"), F.count_if(x > F.col("_b")).alias("_c3"))
        before, through = F.col("_below") + F.col("_c1"), F.col("_below") + F.col("_c1") + F.col("_c2")
        low, high = F.col("_place") < before, F.col("_place") >= through
        pick = lambda a, b, c: F.when(low, a).when(high, b).otherwise(c)
        narrowed = counted.select(
            *keys,
            pick(F.col("_lo"), F.col("_b"), F.col("_a")).alias("_lo"),
            pick(F.col("_a"), F.col("_hi"), F.col("_b")).alias("_hi"),
            pick(F.col("_c1") + F.col("_ca"), F.col("_c3") + F.col("_cb"), F.col("_c2")).alias("_inside"),
            pick(F.col("_below"), through - F.col("_cb"), before).alias("_below"),
            "_place",
        )
        places = kept(places.where(~open_).unionByName(narrowed.select(*places.columns)))
    counts = _with(values, places, keys, small).groupBy(*at, "_below", "_x").agg(F.count(F.lit(1)).alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(*at).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_up", F.col("_below") + up_to).where(F.col("_up") > F.col("_place")).groupBy(*at).agg(F.min("_x").alias("_v"))
    found = kept(found)
    for name, f in (("_v0", F.floor), ("_v1", F.ceil)):
        one = found.withColumnsRenamed({k: f"_j_{k}" for k in at} | {"_v": name})
        wanted = wanted.withColumn("_place", f("_at")).join(one, _equal(at), "inner").drop(*[f"_j_{k}" for k in at], "_place")
    value = F.col("_v0") + (F.col("_at") - F.floor("_at")) * (F.col("_v1") - F.col("_v0"))
    return wanted.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, value)).alias(name) for name in shares])


def _equal(names: list[str]):
    out = F.lit(True)
    for k in names:
        out = out & F.col(k).eqNullSafe(F.col(f"_j_{k}"))
    return out
