"""Bars from files and vendors: CSV folders, vendor JSON, and generated walks."""

from __future__ import annotations

import json
import math
import time
import urllib.parse
import urllib.request
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import IngestionError
from tidemark.operators import bars
from tidemark.plans.tables import kept

# Column names that files use for those of bars. An adjusted close wins over a plain one.
ALIASES = {
    "timestamp": ["timestamp", "date", "datetime", "time"],
    "open": ["open"],
    "high": ["high"],
    "low": ["low"],
    "close": ["adj close", "adj_close", "adjusted close", "close"],
    "volume": ["volume", "vol"],
}
DAILY_ONLY = "1d"
#: A cell of a CSV line that has a comma put before it: quoted, with quotes doubled, or up to the next comma.
CELL = r',\s*("(?:[^"]|"")*"|[^,]*)'


class Source(Protocol):
    """Where bars come from."""

    def fetch(self, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, interval: str = "1d") -> DataFrame: ...

    def symbols(self) -> list[str]: ...


class CsvFolder:
    """A folder of ``SYMBOL.csv`` files, read as one DataFrame with the symbol from the file's name.

    All columns are read as text, however many there are, with quoted cells kept together (a quoted line end is not). A
    file that lacks a column of bars, or a time that can't be read, is an error; numbers that can't be (also such as
    "5,000"), and cells that a short line lacks, are missing values, filled as ``fill`` says; no line is left out. Bars then
    are resampled to the interval and checked.
    """

    def __init__(self, spark: SparkSession, path: str, fill: str = "ffill"):
        self.spark, self.path, self.fill = spark, path, fill

    def _symbol(self, name: Column) -> Column:
        return F.upper(F.regexp_extract(name, r"([^/]*)\.[cC][sS][vV]$", 1))

    def _raw(self, symbols: list[str] | None) -> DataFrame:
        lines = self.spark.read.text(f"{self.path}/*.csv").select(F.regexp_replace("value", "\r$", "").alias("line"), self._symbol(F.col("_metadata.file_name")).alias("symbol"), F.col("_metadata.file_path").alias("path"))
        if symbols:
            lines = lines.where(F.col("symbol").isin([s.upper() for s in symbols]))

        def cells(line: Column) -> Column:
            bare = lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
            return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1)), lambda x: F.trim(bare(F.trim(x))))

        # Each file may have its own header: the line that has a cell named as an opening price.
        maybe = lines.where(F.lower("line").contains("open")).withColumn("cells", F.transform(cells(F.col("line")), lambda x: F.lower(x)))
        heads = maybe.where(F.arrays_overlap("cells", F.array(*map(F.lit, ALIASES["open"])))).groupBy("path").agg(F.min(F.struct("line", "cells")).alias("head"))
        files_ = lines.select("path", "symbol").distinct().join(heads, "path", "left")
        lacking = F.filter(F.array(*[F.when(~F.coalesce(F.arrays_overlap("head.cells", F.array(*map(F.lit, names))), F.lit(False)), F.lit(c)) for c, names in ALIASES.items()]), lambda c: c.isNotNull())
        if bad := files_.select("symbol", lacking.alias("lacking")).where(F.size("lacking") > 0).orderBy("symbol").limit(5).collect():
            raise IngestionError("; ".join(f"{r.symbol} has no column {', '.join(r.lacking)}" for r in bad))
        body = lines.join(heads, "path").where(F.col("line") != F.col("head.line")).where(F.trim("line") != "").withColumn("cells", cells(F.col("line")))

        def cell(aliases: list[str]) -> Column:
            places = [F.array_position("head.cells", n) for n in aliases]
            return F.coalesce(*[F.when(at > 0, F.get("cells", (at - 1).cast("int"))) for at in places])

        return body.select("symbol", *[cell(aliases).alias(c) for c, aliases in ALIASES.items()])

    def symbols(self) -> list[str]:
        """The names of all files, also of those that can't be read as bars."""
        names = self.spark.read.format("binaryFile").load(f"{self.path}/*.csv").select(self._symbol(F.col("path")).alias("symbol"))
        return [r.symbol for r in names.distinct().orderBy("symbol").collect()]

    def fetch(self, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, interval: str = "1d") -> DataFrame:
        raw = self._raw(symbols)
        number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
        made = raw.select("symbol", F.to_timestamp_ntz(F.try_to_timestamp("timestamp").cast("string")).alias("ts"), *[number(c).alias(c) for c in [*bars.PRICES, "volume"]])
        if bad := made.where("ts is null").count():
            raise IngestionError(f"{bad} times can't be read")
        made = bars.between(made, start, end)
        if made.isEmpty():
            raise IngestionError("no bars in the range")
        made = bars.fill(made, self.fill)
        return bars.checked(made if interval == DAILY_ONLY else bars.resample(made, interval))


def parse_vendor_json(texts: DataFrame, column: str = "body", symbol: str = "symbol", scaled: bool = False) -> DataFrame:
    """Bars of vendor answers (one JSON text a row): the first member whose name begins with "Time Series" maps times
    to fields such as "4. close". An adjusted close wins. Answers without such a member give no rows.

    An adjusted close beside prices that are not adjusted may lie outside of low and high after a split or a dividend, and
    then fails the checks. ``scaled`` adjusts the other prices by the same factor, adjusted close over close (as they are
    where one of these is missing, or the close is zero)."""
    members = F.from_json(column, "map<string,string>")
    series = F.element_at(F.map_values(F.map_filter(members, lambda k, _: k.startswith("Time Series"))), 1)
    rows = texts.where(F.size(F.map_filter(members, lambda k, _: k.startswith("Time Series"))) > 0).select(F.col(symbol).alias("symbol"), F.explode(F.from_json(series, "map<string,map<string,string>>")).alias("at", "fields"))
    named = F.transform_keys("fields", lambda k, _: F.lower(F.trim(F.regexp_replace(k, r"^[^.]*\.", ""))))
    rows = rows.withColumn("f", named)
    get = lambda *names: F.coalesce(*[F.try_element_at("f", F.lit(n)) for n in names]).try_cast("double")
    factor = F.coalesce(get("adjusted close") / F.nullif(get("close"), F.lit(0.0)), F.lit(1.0)) if scaled else F.lit(1.0)
    prices = [(get(c) * factor if scaled else get(c)).alias(c) for c in ("open", "high", "low")]
    return rows.select("symbol", F.col("at").cast("timestamp_ntz").alias("ts"), *prices, get("adjusted close", "close").alias("close"), get("volume").alias("volume"))


ATTEMPTS, WAIT = 3, 2.0
# What the vendor calls the intervals.
VENDOR_INTERVALS = {
    "1d": {"function": "TIME_SERIES_DAILY_ADJUSTED"},
    "1min": {"function": "TIME_SERIES_INTRADAY", "interval": "1min"},
    "5min": {"function": "TIME_SERIES_INTRADAY", "interval": "5min"},
    "15min": {"function": "TIME_SERIES_INTRADAY", "interval": "15min"},
    "1h": {"function": "TIME_SERIES_INTRADAY", "interval": "60min"},
}


def vendor_params(symbol: str, interval: str, key: str) -> dict:
    if interval not in VENDOR_INTERVALS:
        raise IngestionError(f"unknown interval {interval!r}")
    return VENDOR_INTERVALS[interval] | {"symbol": symbol.upper(), "outputsize": "full", "apikey": key}


def _got(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as found:
        return found.read().decode()


def answer(url: str, params: dict, get: Callable[[str], str] = _got, sleep: Callable[[float], None] = time.sleep, wait: float = WAIT) -> str:
    """The vendor's text. A request without an answer is sent again, ``ATTEMPTS`` times in all; an answer that says that
    something is wrong is an error at once."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            text = get(f"{url}?{urllib.parse.urlencode(params)}")
            break
        except OSError as e:
            if attempt == ATTEMPTS:
                raise IngestionError(f"no answer after {attempt} attempts") from e
            sleep(wait**attempt)
    found = json.loads(text)
    for k in ("Error Message", "Note"):
        if k in found:
            raise IngestionError(found[k])
    return text


class VendorHttp:
    """A vendor's JSON over HTTP: each symbol is asked for by a task of its own, once, and parsed by Spark. With a ``get`` of
    one's own the driver asks. ``scaled`` as in ``parse_vendor_json``."""

    def __init__(self, spark: SparkSession, url: str, key: str, get: Callable[[str], str] | None = None, sleep: Callable[[float], None] = time.sleep, scaled: bool = False):
        self.spark, self.url, self.key, self.get, self.sleep, self.scaled = spark, url, key, get, sleep, scaled

    def _texts(self, symbols: list[str], interval: str) -> DataFrame:
        if self.get:
            texts = [(s.upper(), answer(self.url, vendor_params(s, interval, self.key), self.get, self.sleep)) for s in symbols]
            return self.spark.createDataFrame(texts, "symbol string, body string")
        from tidemark.sources import formats  # reads with this module

        formats.register(self.spark)
        options = {"url": self.url, "key": self.key, "interval": interval, "symbols": ",".join(symbols)}
        return kept(self.spark.read.format("tidemark_answers").options(**options).load())

    def fetch(self, symbols: list[str], start: str | None = None, end: str | None = None, interval: str = "1d") -> DataFrame:
        vendor_params("", interval, "")
        made = bars.between(parse_vendor_json(self._texts(symbols, interval), scaled=self.scaled), start, end)
        if made.isEmpty():
            raise IngestionError("no bars in the range")
        return bars.checked(made)


def generated(spark: SparkSession, symbols: dict[str, tuple[float, float, float]], start: str, end: str, seed: int = 42) -> DataFrame:
    """Bars of geometric walks on business days, for ``{symbol: (first price, drift, volatility) a year}``. Draws depend
    on seed, symbol and day alone. Prices have two decimals and are 0.01 at least; some days trade three times as much."""
    rows = spark.createDataFrame([(s, *map(float, v)) for s, v in symbols.items()], "symbol string, price double, mu double, sigma double")
    return generated_of(rows.withColumns({"start": F.lit(start).cast("date"), "end": F.lit(end).cast("date")}), seed)


def generated_of(rows: DataFrame, seed: int = 42) -> DataFrame:
    """``generated`` bars for a table of ``symbol, price, mu, sigma, start, end``."""
    days = rows.withColumn("day", F.explode(F.sequence("start", "end"))).where(F.dayofweek("day").between(2, 6))
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), "symbol", "day", F.lit(k)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    normal = lambda k: F.sqrt(-2 * F.log(uniform(k))) * F.cos(2 * math.pi * uniform(k + 100))
    dt = 1 / 252
    w = Window.partitionBy("symbol").orderBy("day")
    step = (F.col("mu") - F.col("sigma") ** 2 / 2) * dt + F.col("sigma") * math.sqrt(dt) * normal(1)
    close = F.col("price") * F.exp(F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    made = days.withColumn("_step", step).withColumn("_c", close)
    made = made.withColumn("_o", F.coalesce(F.lag("_c").over(w), F.col("price")) * F.exp(0.1 * F.col("sigma") * math.sqrt(dt) * normal(2)))
    reach = lambda k: F.abs(normal(k)) * F.col("sigma") * math.sqrt(dt) * 0.5
    made = made.withColumn("_h", F.greatest("_o", "_c") * (1 + reach(3))).withColumn("_l", F.least("_o", "_c") * (1 - reach(4)))
    volume = F.round(1e6 * F.exp(0.3 * normal(5)) * F.when(uniform(6) > 0.95, 3.0).otherwise(1.0))
    cents = lambda c: F.greatest(F.round(c, 2), F.lit(0.01))
    return made.select("symbol", F.col("day").cast("timestamp_ntz").alias("ts"), *[cents(x).alias(c) for x, c in (("_o", "open"), ("_h", "high"), ("_l", "low"), ("_c", "close"))], volume.alias("volume"))
