"""Windows over series of any length: segments of rows in many tasks, with what they take over from those before.

A window function over a key runs in one task, however long the key's series is. Here rows are first numbered without such
a task (ranges of keys and order, sorted, each with the number of rows before it), and then cut into segments of so many
rows. Running totals are made in each segment and joined with the combined totals of the segments before; frames of n rows
see n - 1 rows of the segment before, which are sent along. Segments' totals, one row each, are all that one task sees of
a series.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.plans.tables import kept

#: Rows of a segment.
SIZE = 1 << 16
ROW, SEGMENT, AHEAD = "_row_", "_segment_", "_ahead_"
_IN_PARTITION = (1 << 33) - 1


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equal columns, nulls being a value; ``right`` has them with an underscore before."""
    out = F.lit(True)
    for c in names:
        out = out & left[c].eqNullSafe(right[f"_{c}"])
    return out


def _joined(df: DataFrame, totals: DataFrame, names: list[str]) -> DataFrame:
    named = totals.withColumnsRenamed({c: f"_{c}" for c in names})
    return df.join(named, _same(df, named, names), "left").drop(*[f"_{c}" for c in names])


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ROW, each row's place (from 0) in its key's series. Rows with one key and order come in any order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    cut = kept(df.repartitionByRange(n, *at).sortWithinPartitions(*at).withColumn("_m", F.monotonically_increasing_id()))
    cut = cut.withColumns({"_p": F.shiftright("_m", 33), "_r": F.col("_m").bitwiseAND(F.lit(_IN_PARTITION))}).drop("_m")
    runs = cut.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return _joined(cut, runs, [*keys, "_p"]).withColumn(ROW, F.col("_r") + F.col("_base")).drop("_p", "_r", "_base")


def overlapping(rows: DataFrame, size: int, back: int) -> DataFrame:
    """``numbered`` rows with SEGMENT; the last ``back`` rows of a segment come again, marked AHEAD, before the next."""
    if back > size:
        raise ValueError("a segment must hold the rows that a frame reaches back")
    own = F.floor(F.col(ROW) / size)
    pair = lambda at, ahead: F.struct(at.alias(SEGMENT), F.lit(ahead).alias(AHEAD))
    both = F.when(F.col(ROW) % size >= size - back, F.array(pair(own, False), pair(own + 1, True))).otherwise(F.array(pair(own, False)))
    return rows.withColumn("_at", F.explode(both)).select(*rows.columns, "_at.*")


def rolling(df: DataFrame, keys: list[str], order: list[str], back: int, made: Callable[[WindowSpec], dict[str, Column]], size: int = SIZE) -> DataFrame:
    """Adds the columns that ``made`` gives for an ordered window, whose frames reach back at most ``back`` rows."""
    cut = overlapping(numbered(df, keys, order), max(size, back), back)
    w = Window.partitionBy(*keys, SEGMENT).orderBy(ROW)
    added = made(w)
    return cut.withColumns(added).where(~F.col(AHEAD)).select(*df.columns, *added)


#: Running totals: how a segment's rows are combined, and how a total of those before is taken over.
_TOTALS = {
    "sum": (F.sum, lambda a, b: a + b),
    "count": (F.count, lambda a, b: a + b),
    "product": (F.product, lambda a, b: a * b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (lambda c: F.last(c, True), lambda a, b: b),
}


def running(df: DataFrame, keys: list[str], order: list[str], wanted: dict[str, tuple[str, str]], size: int = SIZE) -> DataFrame:
    """Adds running totals ``{name: (kind, column)}`` from each series' first row on; kinds are sum, count, product, max, min
    and last (the last value that is not null)."""
    rows = numbered(df, keys, order).withColumn(SEGMENT, F.floor(F.col(ROW) / size))
    rows, totals = kept(rows), {}
    every = Window.partitionBy(*keys, SEGMENT).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, column) in wanted.items():
        of = _TOTALS[kind][0]
        totals[f"_t_{name}"] = F.max_by(column, F.when(F.col(column).isNotNull(), F.col(ROW))) if kind == "last" else of(F.col(column))
    ends = rows.groupBy(*keys, SEGMENT).agg(*[t.alias(name) for name, t in totals.items()])
    carried = {f"_c_{name}": (F.sum if kind == "count" else _TOTALS[kind][0])(F.col(f"_t_{name}")).over(earlier) for name, (kind, _) in wanted.items()}
    ends = ends.select(*keys, SEGMENT, *[c.alias(name) for name, c in carried.items()])
    made = _joined(rows.withColumns({f"_i_{name}": _TOTALS[kind][0](F.col(column)).over(every) for name, (kind, column) in wanted.items()}), ends, [*keys, SEGMENT])

    def whole(name: str, kind: str) -> Column:
        before, inside = F.col(f"_c_{name}"), F.col(f"_i_{name}")
        return F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(_TOTALS[kind][1](before, inside))

    return made.select(*df.columns, *[whole(name, kind).alias(name) for name, (kind, _) in wanted.items()])


def drawdown(df: DataFrame, keys: list[str], order: list[str], column: str, name: str = "drawdown", size: int = SIZE) -> DataFrame:
    """Adds the distance from the highest value so far, as a share of it."""
    made = running(df, keys, order, {"_top": ("max", column)}, size)
    return made.withColumn(name, series.ratio(F.col(column) - F.col("_top"), F.col("_top"))).drop("_top")


def ema(df: DataFrame, columns: dict[str, tuple[str, float]], keys: list[str], order: list[str], size: int = SIZE) -> DataFrame:
    """``series.ema`` for series of any length: adds exponential averages ``{name: (column, alpha)}`` of columns without
    nulls. A segment's average starts from its first value x; what the average y before it changes is
    (1 - alpha) ** (rows so far) * (y - x), so that a segment maps y to a * y + b, and few segments before matter."""
    if bad := [name for name, (_, alpha) in columns.items() if not 0 < alpha < 1]:
        raise ValueError(f"alpha must lie between 0 and 1: {bad}")
    rows = numbered(df, keys, order).withColumn(SEGMENT, F.floor(F.col(ROW) / size))
    alone = kept(series.ema(rows, {f"_y_{name}": x for name, x in columns.items()}, [*keys, SEGMENT], ROW))
    at, last = (F.col(ROW) % size + 1).cast("double"), F.max(ROW) % size + 1
    maps = alone.groupBy(*keys, SEGMENT).agg(*[F.min_by(c, ROW).alias(f"_x_{name}") for name, (c, _) in columns.items()], *[F.max_by(f"_y_{name}", ROW).alias(f"_e_{name}") for name in columns], last.alias("_rows"))

    def before(name: str, keep: float) -> Column:
        back = max(1, math.ceil(math.log(series.NEGLIGIBLE) / (size * math.log(keep))))
        w = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(-back, -1)
        part = F.pow(F.lit(keep), F.col("_rows"))
        earlier = F.collect_list(F.struct(part.alias("a"), (F.col(f"_e_{name}") - part * F.col(f"_x_{name}")).alias("b"), F.col(f"_e_{name}").alias("e"))).over(w)
        # The earliest of them stands for all before it: its own average, with a first value of its own.
        return F.when(F.size(earlier) > 0, F.aggregate(F.slice(earlier, 2, back), F.get(earlier, 0)["e"], lambda y, m: m["a"] * y + m["b"]))

    maps = maps.select(*keys, SEGMENT, *[f"_x_{name}" for name in columns], *[before(name, 1 - alpha).alias(f"_in_{name}") for name, (_, alpha) in columns.items()])
    made = _joined(alone, maps, [*keys, SEGMENT])
    shift = lambda name, keep: F.coalesce(F.pow(F.lit(keep), at) * (F.col(f"_in_{name}") - F.col(f"_x_{name}")), F.lit(0.0))
    return made.select(*df.columns, *[(F.col(f"_y_{name}") + shift(name, 1 - alpha)).alias(name) for name, (_, alpha) in columns.items()])
