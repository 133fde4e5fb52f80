"""Parquet tables of bars and runs under one folder."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import StoreError
from tidemark.operators import bars as bar_ops
from tidemark.operators import metrics
from tidemark.plans.tables import kept

_ASKED = "interval string, start_at timestamp_ntz, end_at timestamp_ntz, capital double, commission double, slippage double"
_RUNS = f"run_id string, strategy string, params string, created_at timestamp_ntz, symbol string, {_ASKED}, " + ", ".join(f"{m} {'long' if m == 'n_periods' else 'double'}" for m in metrics.NAMES)
SCHEMAS = {
    "ohlcv": "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, interval string",
    "made_bars": "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, interval string, period string",
    "backtest_runs": _RUNS,
    "fills": "run_id string, symbol string, ts timestamp_ntz, side string, quantity double, fill_price double, commission double, slippage double",
    "equity_curve": "run_id string, symbol string, ts timestamp_ntz, equity double, r double",
    "walkforward_runs": "run_id string, created_at timestamp_ntz, strategy string, param_grid string, train int, test int, step int, symbol string, window int, best_params string, is_sharpe double, oos_sharpe double, oos_n_bars long",
    "montecarlo_runs": "run_id string, created_at timestamp_ntz, backtest_run_id string, horizon int, method string, series_id string, scenario string, n_sims long, p5 double, p50 double, p95 double, var_95 double, cvar_95 double, var_99 double, cvar_99 double",
    "deleted_runs": "run_id string, deleted_at timestamp_ntz",
}
#: Symbols that are named in a filter of partitions.
LISTED = 1000
#: A run is a partition of its tables: writing it again puts the same rows in the place of the old ones.
RUN_TABLES = ("backtest_runs", "fills", "equity_curve", "walkforward_runs", "montecarlo_runs")
PARTITIONS = {"ohlcv": ["interval", "symbol"], "made_bars": ["interval", "symbol", "period"], **{t: ["run_id"] for t in RUN_TABLES}}


def _now() -> Column:
    return F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")


class Store:
    """Tables by name; a table that has not been written is empty. Bars are appended. A run takes the place of one with
    its id. A deleted run is listed as such, in one append, and is seen no more until it is saved again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise StoreError(f"no table {name!r}")
        try:
            rows = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self._visible(name, rows) if name in RUN_TABLES else rows

    def _visible(self, name: str, rows: DataFrame) -> DataFrame:
        gone = self.table("deleted_runs").groupBy("run_id").agg(F.max("deleted_at").alias("_deleted"))
        if "created_at" in rows.columns:
            return rows.join(gone, "run_id", "left").where("_deleted is null or created_at > _deleted").select(*rows.columns)
        return rows.join(self.table("backtest_runs").select("run_id").distinct(), "run_id", "left_semi")

    def _rows(self, name: str, rows: DataFrame) -> DataFrame:
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def append(self, name: str, rows: DataFrame) -> None:
        self._rows(name, rows).write.mode("append").partitionBy(*PARTITIONS.get(name, [])).parquet(f"{self.path}/{name}")

    def replace_run(self, name: str, rows: DataFrame) -> None:
        """Puts the rows in the place of those of the same partitions (runs)."""
        self._rows(name, rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS[name]).parquet(f"{self.path}/{name}")

    def upsert_bars(self, new: DataFrame, interval: str = "1d") -> int:
        """Appends the bars whose (symbol, interval, ts) is not there yet; returns how many. Of the stored bars only the keys
        in the new bars' interval, symbols and range of time are read."""
        rows = kept(new.withColumn("interval", F.lit(interval)).dropDuplicates(["symbol", "ts"]))
        rows = kept(absent(rows, self.held(rows, interval), ["symbol", "interval", "ts"]))
        n = rows.count()
        if n:
            self.append("ohlcv", rows)
        return n

    def held(self, rows: DataFrame, interval: str) -> DataFrame:
        """Stored bars that rows may meet: partitions of the interval and, up to ``LISTED`` of them, of the symbols."""
        first, last = rows.agg(F.min("ts"), F.max("ts")).first()
        symbols = [r.symbol for r in rows.select("symbol").distinct().limit(LISTED + 1).collect()]
        held = self.table("ohlcv").where((F.col("interval") == interval) & F.col("ts").between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
        return held.where(F.col("symbol").isin(symbols)) if len(symbols) <= LISTED else held

    def add(self, new: DataFrame, interval: str, longer: list[str]) -> int:
        """Adds bars as ``upsert_bars`` does, and makes those bars of the ``longer`` intervals again that the new ones lie in,
        whether these come in order or late; returns how many bars were added. Bars of other intervals of time are neither
        read from the stored ones nor computed. May be called again with the same bars, also after it was interrupted."""
        new = kept(new)
        n = self.upsert_bars(new, interval)
        for i in longer:
            self.remake(new, interval, i)
        return n

    def remake(self, new: DataFrame, interval: str, longer: str) -> None:
        """Makes the longer bars that ``new`` ones lie in from the stored ones. They take the place of the old ones in
        ``made_bars``, whose partitions are an interval, a symbol and a month (a year, for days and weeks): only
        partitions with such bars are written, with the bars in them that stay. Called with all stored bars it makes the
        table anew."""
        label = bar_ops.interval_start(F.col("ts"), longer)
        touched = kept(new.select("symbol", label.alias("ts"), _period(label, longer).alias("period")).distinct())
        first, last = touched.agg(F.min("ts"), F.max("ts")).first()
        if first is None:
            return
        # A label is at most a week from the times that have it; so much more is read, and then left out.
        near = F.col("ts").between(F.lit(first - timedelta(days=7)).cast("timestamp_ntz"), F.lit(last + timedelta(days=7)).cast("timestamp_ntz"))
        symbols = [r.symbol for r in touched.select("symbol").distinct().limit(LISTED + 1).collect()]
        listed = F.col("symbol").isin(symbols) if len(symbols) <= LISTED else F.lit(True)
        source = self.table("ohlcv").where((F.col("interval") == interval) & listed & near)
        source = source.withColumn("_label", label)
        source = source.join(touched.select("symbol", F.col("ts").alias("_label")), ["symbol", "_label"], "left_semi")
        made = bar_ops.resample(source, longer).withColumns({"interval": F.lit(longer), "period": _period(F.col("ts"), longer)})
        periods = touched.select("symbol", "period").distinct()
        held = self.table("made_bars").where((F.col("interval") == longer) & listed).join(periods, ["symbol", "period"], "left_semi")
        stay = absent(held, touched, ["symbol", "ts"])
        both = kept(self._rows("made_bars", stay).unionByName(self._rows("made_bars", made)))  # before what it reads is replaced
        self.replace_run("made_bars", both)

    def made_bars(self, interval: str) -> DataFrame:
        return self.table("made_bars").where(F.col("interval") == interval).drop("interval", "period")

    def bars(self, symbol: str, interval: str = "1d", start: str | None = None, end: str | None = None) -> DataFrame:
        rows = self.table("ohlcv").where((F.col("symbol") == symbol) & (F.col("interval") == interval))
        return bar_ops.between(rows, start, end).drop("interval").orderBy("ts")

    def save_run(self, run_id: str, strategy: str, params: dict, equity: DataFrame, traded: DataFrame, measured: DataFrame, asked: dict | None = None) -> None:
        """Fills and equity first, then the run itself, so that a run that is seen is whole. ``asked``: interval, capital,
        commission and slippage; start and end are those of each symbol's equity."""
        rounded = measured.select("symbol", *[(F.round(m, 6) if m != "n_periods" else F.col(m)).alias(m) for m in metrics.NAMES])
        ends = equity.groupBy("symbol").agg(F.min("ts").alias("start_at"), F.max("ts").alias("end_at"))
        head = {"run_id": F.lit(run_id), "strategy": F.lit(strategy), "params": F.lit(json.dumps(params, sort_keys=True)), "created_at": _now(), **{k: F.lit(v) for k, v in (asked or {}).items()}}
        self.replace_run("fills", traded.withColumn("run_id", F.lit(run_id)))
        self.replace_run("equity_curve", equity.withColumn("run_id", F.lit(run_id)))
        self.replace_run("backtest_runs", rounded.join(ends, "symbol", "left").withColumns(head))

    def save_walk_forward(self, run_id: str, strategy: str, space: dict, sizes: tuple[int, int, int], reported: DataFrame) -> None:
        """The windows of a walk-forward report, with what was asked."""
        head = {"run_id": F.lit(run_id), "created_at": _now(), "strategy": F.lit(strategy), "param_grid": F.lit(json.dumps(space, sort_keys=True)), **{k: F.lit(v) for k, v in zip(("train", "test", "step"), sizes, strict=True)}}
        self.replace_run("walkforward_runs", reported.withColumns(head))

    def save_monte_carlo(self, run_id: str, summary: DataFrame, horizon: int, method: str, backtest_run_id: str | None = None) -> None:
        """The summary of a simulation, of all its scenarios."""
        head = {"run_id": F.lit(run_id), "created_at": _now(), "horizon": F.lit(horizon), "method": F.lit(method), "backtest_run_id": F.lit(backtest_run_id)}
        self.replace_run("montecarlo_runs", summary.withColumns(head))

    def run(self, run_id: str) -> DataFrame:
        rows = self.table("backtest_runs").where(F.col("run_id") == run_id)
        if rows.isEmpty():
            raise StoreError(f"no run {run_id!r}")
        return rows

    def runs(self, strategy: str | None = None, symbol: str | None = None, limit: int = 50) -> DataFrame:
        """The latest runs first."""
        rows = self.table("backtest_runs")
        for c, v in (("strategy", strategy), ("symbol", symbol)):
            if v is not None:
                rows = rows.where(F.col(c) == v)
        return rows.orderBy(F.desc("created_at"), "run_id", "symbol").limit(limit)

    def fills_of_runs(self) -> DataFrame:
        """Runs with their fills: a row for each fill, with the run's strategy and parameters."""
        return self.table("backtest_runs").select("run_id", "symbol", "strategy", "params").join(self.table("fills"), ["run_id", "symbol"])

    def delete_run(self, run_id: str) -> None:
        """A run with its fills and equity is seen no more."""
        self.append("deleted_runs", self.spark.range(1).select(F.lit(run_id).alias("run_id"), _now().alias("deleted_at")))


def _period(ts: Column, interval: str) -> Column:
    return F.date_format(ts, "yyyy" if interval in ("1d", "1w") else "yyyy-MM")


def absent(new: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose keys are not held."""
    return new.join(held.select(*keys), keys, "left_anti")
