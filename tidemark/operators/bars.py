"""Bars: (symbol, ts, open, high, low, close, volume). Making, resampling, filling and checking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigurationError, DataIntegrityError

PRICES = ["open", "high", "low", "close"]
COLUMNS = ["symbol", "ts", *PRICES, "volume"]
#: Intervals and their window durations; a week runs from Monday to Sunday and is labelled by its Sunday.
INTERVALS = {"1min": "1 minute", "5min": "5 minutes", "15min": "15 minutes", "1h": "1 hour", "1d": "1 day", "1w": "week"}


def interval_start(ts: Column, interval: str) -> Column:
    """The label of the interval that a time lies in: its begin, or for weeks the Sunday that ends it."""
    if interval not in INTERVALS:
        raise ConfigurationError(f"unknown interval {interval!r}; known: {sorted(INTERVALS)}")
    if interval == "1w":
        return F.next_day(F.date_sub(ts.cast("date"), 1), "SUN").cast("timestamp_ntz")
    return F.window(ts, INTERVALS[interval])["start"].cast("timestamp_ntz")


def from_ticks(ticks: DataFrame, symbol: str, ts: str, price: str, tie: str, interval: str) -> DataFrame:
    """Bars of single prices: first, greatest, least, last, and the sum as volume; equal times go by ``tie``."""
    label = {"1h": F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz"), "1d": F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")}.get(interval)
    label = interval_start(F.col(ts), interval) if label is None else label
    at = F.struct(F.col(ts), F.col(tie))
    keys = [F.col(symbol).alias("symbol"), label.alias("ts")]
    return ticks.where(F.col(price).isNotNull()).groupBy(*keys).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(price).alias("volume"))


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Longer bars of shorter ones: first open, greatest high, least low, last close, total volume. Nulls are skipped,
    and intervals without any bar do not appear. Daily input stays as it is."""
    label = interval_start(F.col("ts"), interval)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
    out = bars.groupBy("symbol", label.alias("label")).agg(first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close").alias("close"), F.sum("volume").alias("volume"))
    return out.where(F.coalesce(*PRICES).isNotNull()).withColumnRenamed("label", "ts").select(*COLUMNS)


def between(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from start to end, both included; a date stands for its midnight."""
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return bars if end is None else bars.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))


def fill(bars: DataFrame, how: str = "ffill") -> DataFrame:
    """Fills missing values of each symbol, if any of its prices is missing; else only that symbol's rows as they are.

    ``ffill``: the last value before, else the next one. ``drop``: no rows with a missing price. ``interpolate``: on
    the line in time between the neighbours, and at the ends as ffill. What is then missing of volume is 0.
    """
    if how not in ("ffill", "drop", "interpolate"):
        raise ConfigurationError(f"unknown fill {how!r}")
    if how == "drop":
        return bars.dropna(subset=PRICES)
    w = Window.partitionBy("symbol").orderBy("ts")
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    missing = F.max(F.greatest(*[F.col(c).isNull().cast("int") for c in PRICES])).over(Window.partitionBy("symbol")) > 0

    def filled(c: str) -> Column:
        before, after = F.last(c, True).over(back), F.first(c, True).over(on)
        if how == "ffill":
            return F.coalesce(before, after)
        seconds = lambda t: F.unix_micros(t.cast("timestamp")) / F.lit(1e6)
        here = seconds(F.col("ts"))
        t0, t1 = (F.last(F.when(F.col(c).isNotNull(), here), True).over(back), F.first(F.when(F.col(c).isNotNull(), here), True).over(on))
        line = before + (after - before) * ((here - t0) / (t1 - t0))
        return F.coalesce(F.col(c), line, before, after)

    made = bars.withColumn("_missing", missing).select("symbol", "ts", "_missing", *[F.when(F.col("_missing"), filled(c)).otherwise(F.col(c)).alias(c) for c in [*PRICES, "volume"]])
    return made.withColumn("volume", F.when(F.col("_missing"), F.coalesce("volume", F.lit(0.0))).otherwise(F.col("volume"))).drop("_missing")


#: Checks in the order in which the first that fails is raised.
CHECKS = ["unsorted_rows", "duplicate_rows", "high_too_low", "low_too_high", "negative_values", "empty_rows"]


def report(bars: DataFrame, jump: float = 0.5, max_gap_days: float = 5, place: str | None = None) -> DataFrame:
    """One row for each symbol: rows, violations by check, and, as warnings, closes that moved by more than ``jump`` and times
    that are more than ``max_gap_days`` after the ones before them. Rows of a DataFrame have no order of their own; where
    ``place`` names a column with each row's place in what was read, rows whose time is before that of the row at the place
    before are counted as unsorted (else none)."""
    w = Window.partitionBy("symbol").orderBy("ts")
    step = F.abs(F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1)
    gap = F.col("ts") - F.lag("ts").over(w) > F.make_dt_interval(secs=F.lit(max_gap_days * 86400))
    again = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy("ts")) > 1
    back = F.col("ts") < F.lag("ts").over(Window.partitionBy("symbol").orderBy(place)) if place else F.lit(False)
    seen = bars.withColumns({"_step": step, "_gap": gap, "_again": again, "_back": back})
    negative = F.lit(False)
    for c in [*PRICES, "volume"]:
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return seen.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        count(F.col("_back")).alias("unsorted_rows"),
        count(F.col("_again")).alias("duplicate_rows"),
        count(F.col("high") < F.greatest("open", "close")).alias("high_too_low"),
        count(F.col("low") > F.least("open", "close")).alias("low_too_high"),
        count(negative).alias("negative_values"),
        count(F.coalesce(*PRICES).isNull()).alias("empty_rows"),
        count(F.col("_step") > jump).alias("jumps"),
        count(F.col("_gap")).alias("gaps"),
    )


def zone_warnings(bars: DataFrame) -> list[str]:
    """What may be wrong with the times of bars: they are times of UTC without a zone, so a column with one is read by the
    session's zone, which should then be UTC; a text or a date is no time."""
    kind, zone = dict(bars.dtypes)["ts"], bars.sparkSession.conf.get("spark.sql.session.timeZone")
    if kind == "timestamp_ntz":
        return []
    if kind == "timestamp":
        return [] if zone in ("UTC", "Etc/UTC", "GMT", "+00:00") else [f"ts has a zone and the session's is {zone}"]
    return [f"ts is a {kind}"]


def checked(bars: DataFrame, place: str | None = None) -> DataFrame:
    """``bars``, or DataIntegrityError with the first check that fails and its count."""
    if lost := [c for c in COLUMNS if c not in bars.columns]:
        raise DataIntegrityError(f"missing columns: {lost}")
    totals = report(bars, place=place).agg(*[F.sum(c).alias(c) for c in CHECKS]).first()
    for c in CHECKS:
        if totals[c]:
            raise DataIntegrityError(f"{c.replace('_', ' ')}: {totals[c]}")
    return bars
