"""Formats of ``spark.read``, bars that are kept up to date, and the options of checks and walk-forward."""

import json
import os
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.operators import bars, walkforward
from tidemark.sources import files, formats
from tidemark.sources.store import Store
from tidemark.streaming import live

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
HEAD = "date,open,high,low,close,volume\n"


def minutes(n=900, symbols=("A", "B"), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        at = np.sort(rng.choice(60 * 24 * 40, n, replace=False))
        close = np.round(100 + rng.normal(0, 1, n), 2)
        rows += [(s, datetime(2024, 1, 20) + timedelta(minutes=int(m)), c, c + 1, c - 1, c, float(v)) for m, c, v in zip(at, close.tolist(), rng.integers(1, 9, n), strict=True)]
    return rows


def collected(df):
    return sorted(map(tuple, df.select(*bars.COLUMNS).collect()))


def test_csv_format_reads_only_what_is_asked_for(spark, tmp_path):
    (tmp_path / "abc.csv").write_text('Date,Open,High,Low,"Adj Close",Close,Vol\n2024-01-02,1,2,0.5,1.5,9,"5,000"\n\n2024-01-01,1,2,1,2\n2024-01-03,"1",2,1,2,9,7\n')
    (tmp_path / "empty.csv").write_text(HEAD)
    (tmp_path / "bad.csv").write_text("date,close\n2024-01-01,1\n")
    read = lambda *symbols, **ends: formats.csv_bars(spark, str(tmp_path), list(symbols), **ends)
    abc = read("abc").orderBy("place")  # bad.csv is not read
    assert [(r.ts.day, r.close, r.volume) for r in abc.collect()] == [(2, 1.5, None), (1, 2, None), (3, 2, 7)]
    late = read("ABC", "empty", start="2024-01-02", end="2024-01-02")
    assert [r.ts.day for r in late.collect()] == [2] and late.rdd.getNumPartitions() == 2
    assert read("NONE").count() == 0
    with pytest.raises(Exception, match="BAD has no column open, high, low, volume"):
        read().count()
    (tmp_path / "when.csv").write_text(HEAD + "never,1,1,1,1,1\n")
    with pytest.raises(Exception, match="times can't be read"):
        read("WHEN").count()


def test_queries_of_one_read_do_not_share_filters(spark, tmp_path):
    formats.write_csv(spark.createDataFrame(minutes(10), BARS), str(tmp_path))
    read = formats.csv_bars(spark, str(tmp_path))
    a, b = read.where("symbol = 'A'"), read.where("symbol = 'B'")
    assert (read.count(), a.count(), read.count(), b.count()) == (20, 10, 20, 10) and {r.symbol for r in a.union(b).collect()} == {"A", "B"}


def test_csv_format_as_a_source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "LINES", 3)
    rows = minutes(40)
    df = spark.createDataFrame(rows, BARS)
    formats.write_csv(df.repartition(5), str(tmp_path))
    assert sorted(p for p in os.listdir(tmp_path) if p.endswith(".csv")) == ["A.csv", "B.csv"] and not os.listdir(tmp_path / "_tmp")
    source = formats.CsvFormat(spark, str(tmp_path), ordered=True)
    assert source.symbols() == ["A", "B"] and collected(source.fetch(interval="1d")) == sorted(rows)
    assert collected(source.fetch(["a"], interval="1h")) == collected(bars.resample(df.where("symbol = 'A'"), "1h"))
    formats.write_csv(df.where("symbol = 'A'").limit(7), str(tmp_path))  # in the place of the file
    assert source.fetch(["A"]).count() == 7 and source.fetch(["B"]).count() == 40
    with pytest.raises(errors.IngestionError, match="no bars"):
        source.fetch(["none"])
    (tmp_path / "B.csv").write_text(HEAD + "2024-01-02,1,1,1,1,1\n2024-01-01,1,1,1,1,1\n")
    assert formats.CsvFormat(spark, str(tmp_path)).fetch(["B"]).count() == 2
    with pytest.raises(errors.DataIntegrityError, match="unsorted rows: 1"):
        source.fetch(["B"])


def test_a_failed_write_puts_nothing_in_place(spark, tmp_path):
    df = spark.createDataFrame([*minutes(3), ("x/y", datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)], BARS)
    with pytest.raises(Exception, match="can't name a file"):
        formats.write_csv(df, str(tmp_path))
    assert not [p for p in os.listdir(tmp_path) if p.endswith(".csv")]


@pytest.fixture
def vendor():
    """A vendor on this machine, which fails each symbol's first request."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            symbol = parse_qs(urlparse(self.path).query)["symbol"][0]
            seen.append(symbol)
            if seen.count(symbol) == 1:
                self.send_error(503)
                return
            body = {"Note": "limit"} if symbol == "BUSY" else {"Time Series (Daily)": {f"2024-01-0{k}": {"1. open": "10", "2. high": "12", "3. low": "9", "4. close": "11", "5. adjusted close": str(5.5 * k), "6. volume": "100"} for k in (1, 2)}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/query", seen
    server.shutdown()


def test_tasks_ask_the_vendor(spark, vendor, monkeypatch):
    url, seen = vendor
    formats.register(spark)
    asked = spark.read.format("tidemark_answers").options(url=url, symbols="abc, ghi,ABC", wait="0.01").load()
    assert asked.rdd.getNumPartitions() == 2
    seen.clear()
    rows = asked.select("symbol", "body").collect()
    assert {r.symbol for r in rows} == {"ABC", "GHI"} and set(seen) == {"ABC", "GHI"} and len(seen) == 4
    made = files.VendorHttp(spark, url, "k", scaled=True).fetch(["abc", "ghi"], end="2024-01-02").where("symbol = 'ABC'").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close) for r in made] == [(5, 6, 4.5, 5.5), (10, 12, 9, 11)] and len(seen) == 6
    with pytest.raises(errors.DataIntegrityError, match="low too high"):
        files.VendorHttp(spark, url, "k").fetch(["abc"])
    with pytest.raises(Exception, match="limit"):
        spark.read.format("tidemark_answers").options(url=url, symbols="BUSY", wait="0.01").load().count()


@pytest.mark.parametrize("seed", [1, 2])
def test_bars_kept_up_to_date_equal_a_full_resample(spark, tmp_path, seed):
    held, rows = Store(spark, f"file://{tmp_path}"), minutes(300)
    dealt = np.random.default_rng(seed).integers(0, 3, len(rows))
    for k in range(3):
        part = spark.createDataFrame([r for r, d in zip(rows, dealt, strict=True) if d == k], BARS)
        assert held.add(part, "1min", ["1h", "1w"]) == int((dealt == k).sum())
    assert held.add(part, "1min", ["1h", "1w"]) == 0  # once more
    df = spark.createDataFrame(rows, BARS)
    for i in ("1h", "1w"):
        assert collected(held.made_bars(i)) == collected(bars.resample(df, i))
    assert held.add(df.limit(0), "1min", ["1h"]) == 0


def test_only_partitions_with_new_bars_are_written(spark, tmp_path):
    held, rows = Store(spark, f"file://{tmp_path}"), minutes(300)
    held.add(spark.createDataFrame(rows, BARS), "1min", ["1h"])
    times = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.glob("made_bars/interval=*/symbol=*/period=*")}
    before = times()
    held.add(spark.createDataFrame([("A", datetime(2024, 1, 25, 3, 7, 30), 5.0, 5.0, 5.0, 5.0, 5.0)], BARS), "1min", ["1h"])
    after = times()
    assert [p[p.index("symbol=") :] for p in after if after[p] != before[p]] == ["symbol=A/period=2024-01"] and len(after) == 4
    assert held.made_bars("1h").where("symbol = 'A' and ts = timestamp_ntz '2024-01-25 03:00:00'").first().low <= 5


def test_a_stream_keeps_bars_up_to_date(spark, tmp_path):
    rows = minutes(200)
    df = spark.createDataFrame(rows, BARS)
    for k in range(2):
        df.where(F.pmod(F.xxhash64("ts"), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    held = Store(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.keep_up_to_date(stream, held, "1min", ["1h"]).option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert collected(held.made_bars("1h")) == collected(bars.resample(df, "1h"))


def test_gaps_order_and_zones(spark):
    day = [1, 2, 9, 3, 20]
    df = spark.createDataFrame([("A", datetime(2024, 1, d), 1.0, 1.0, 1.0, 1.0, 1.0, k) for k, d in enumerate(day)], BARS + ", place long")
    row = bars.report(df, place="place").first()
    assert (row.n_rows, row.unsorted_rows, row.gaps) == (5, 1, 2) and bars.report(df, max_gap_days=6).first().gaps == 1
    assert bars.report(df).first().unsorted_rows == 0 and bars.checked(df).count() == 5
    assert bars.report(df.limit(0), place="place").count() == 0
    assert bars.zone_warnings(df) == [] == bars.zone_warnings(df.withColumn("ts", F.col("ts").cast("timestamp")))
    assert bars.zone_warnings(df.withColumn("ts", F.col("ts").cast("string"))) == ["ts is a string"]


def test_warm_starts_run_all_test_bars(spark):
    close = 100 + np.cumsum(np.random.default_rng(5).normal(0, 1, 200))
    df = spark.createDataFrame(pd.DataFrame({"symbol": "X", "ts": pd.date_range("2020-01-01", periods=200), "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": 1.0}), BARS)
    sizes = {"train": 100, "test": 50, "step": 25}
    space = {"lookback": [5, 60], "vol_window": [5]}
    warm = walkforward.report(df, "momentum", space, warm_start=True, **sizes).collect()
    assert len(warm) == 3 and {r.oos_n_bars for r in warm} == {49}  # 50 bars, 49 returns
    params = walkforward.grid(space)
    chosen = walkforward.windows(df, **sizes).select("symbol", "window", F.lit(1).alias("grid"))
    rows = walkforward.out_of_sample(df, chosen, "momentum", params, warm_start=True, **sizes).where("window = 1").orderBy("ts").collect()
    assert rows[0].ts == datetime(2020, 1, 1) + timedelta(days=125) and [r.direction for r in rows] == [int(np.sign(close[k] - close[k - 60])) for k in range(125, 175)]
    assert walkforward.out_of_sample(df, chosen, "momentum", params, **sizes).count() == 0  # 61 bars are needed
