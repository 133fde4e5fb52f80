"""Sources of bars as formats of ``spark.read``: CSV folders, and a vendor's answers, with a partition for each symbol.

``register(spark)`` makes both known: ::

    spark.read.format("tidemark_csv").option("symbols", "ABC,DEF").option("start", "2024-01-01").load("/bars")
    spark.read.format("tidemark_answers").option("url", url).option("symbols", "ABC,DEF").load()

Symbols that are not asked for are no partitions: nothing of them is read or asked for. Rows out of the range from ``start``
to ``end`` (both included) are left out by the task that reads them. A task that is lost is run again by itself, with its file or its request.
"""

from __future__ import annotations

import csv
import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidemark.errors import IngestionError
from tidemark.operators import bars as bar_ops
from tidemark.plans.tables import kept
from tidemark.sources import files

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, place long"
ARROW = pa.schema([("symbol", pa.string()), ("ts", pa.timestamp("us")), *((c, pa.float64()) for c in ("open", "high", "low", "close", "volume")), ("place", pa.int64())])
#: Lines of a file that a task holds at a time.
LINES = 20_000


@dataclass
class OneSymbol(InputPartition):
    symbol: str
    path: str = ""


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    """Symbols and range are options of the read. ``pushFilters`` is left alone: Spark 4.1 keeps what one query has pushed for
    the next query of the same DataFrame, which then lacks rows."""

    def __init__(self, options: dict):
        self.options = dict(options)
        names = {s.strip().upper() for s in self.options.get("symbols", "").split(",") if s.strip()}
        self.wanted = names or None
        self.ends = [pd.Timestamp(v) if (v := self.options.get(k)) else None for k in ("start", "end")]

    def chosen(self, symbol: str) -> bool:
        return self.wanted is None or symbol in self.wanted


class CsvReader(_Reader):
    def _files(self) -> tuple[fs.FileSystem, dict[str, str]]:
        system, top = _system(self.options["path"])
        found = sorted(i.path for i in system.get_file_info(fs.FileSelector(top)) if i.is_file and i.path.lower().endswith(".csv"))
        return system, {p: posixpath.basename(p)[:-4].upper() for p in found}

    def partitions(self) -> list[InputPartition]:
        return [OneSymbol(s, p) for p, s in self._files()[1].items() if self.chosen(s)] or [OneSymbol("")]

    def read(self, partition: OneSymbol) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = self._files()
        with system.open_input_stream(partition.path) as raw, io.TextIOWrapper(raw, encoding="utf-8-sig", newline="") as text:
            lines, at, place = csv.reader(text, skipinitialspace=True), None, 0
            rows: list[list[str]] = []
            for cells in lines:
                if not any(c.strip() for c in cells):
                    continue
                if at is None:
                    at = self._header(partition.symbol, cells)
                    continue
                rows.append([cells[k].strip() if k < len(cells) else "" for k in at])
                if len(rows) == LINES:
                    yield self._batch(partition.symbol, rows, place)
                    place, rows = place + len(rows), []
            if at is None:
                raise IngestionError(f"{partition.symbol} has no header")
            if rows:
                yield self._batch(partition.symbol, rows, place)

    @staticmethod
    def _header(symbol: str, cells: list[str]) -> list[int]:
        names = [c.strip().lower() for c in cells]
        places = {c: next((names.index(a) for a in aliases if a in names), None) for c, aliases in files.ALIASES.items()}
        if lacking := [c for c, k in places.items() if k is None]:
            raise IngestionError(f"{symbol} has no column {', '.join(lacking)}")
        return list(places.values())

    def _batch(self, symbol: str, rows: list[list[str]], place: int) -> pa.RecordBatch:
        d = pd.DataFrame(rows, columns=["ts", *ARROW.names[2:7]])
        d["ts"] = pd.to_datetime(d.ts, errors="coerce", utc=True, format="mixed").dt.tz_localize(None)
        if bad := int(d.ts.isna().sum()):
            raise IngestionError(f"{symbol}: {bad} times can't be read")
        for c in ARROW.names[2:7]:
            d[c] = pd.to_numeric(d[c], errors="coerce")
        d.insert(0, "symbol", symbol)
        d["place"] = range(place, place + len(d))
        start, end = self.ends
        d = d if start is None else d[d.ts >= start]
        d = d if end is None else d[d.ts <= end]
        return pa.RecordBatch.from_pandas(d, schema=ARROW, preserve_index=False)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class CsvWriter(DataSourceWriter):
    """A task writes each of its symbols to a file of its own under ``_tmp``; the driver then puts files in place by their
    names. What a task that was lost had written is never put in place."""

    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = dict(options), columns

    def write(self, rows: Iterator) -> Written:
        system, top = _system(self.options["path"])
        system.create_dir(f"{top}/_tmp", recursive=True)
        made, now, out = [], None, None
        for r in rows:
            if r["symbol"] != now:
                if out:
                    out.close()
                now = r["symbol"]
                if now is None or "/" in now or now.startswith("."):
                    raise IngestionError(f"{now!r} can't name a file")
                if now in [s for s, _ in made]:
                    raise IngestionError(f"rows of {now} are not together; use write_csv")
                made.append((now, f"{top}/_tmp/{uuid.uuid4().hex}"))
                out = io.TextIOWrapper(system.open_output_stream(made[-1][1]), encoding="utf-8", newline="")
                lines = csv.writer(out)
                lines.writerow(["timestamp", *ARROW.names[2:7]])
            lines.writerow([r["ts"].isoformat(sep=" "), *("" if r[c] is None else repr(r[c]) for c in ARROW.names[2:7])])
        if out:
            out.close()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = _system(self.options["path"])
        for symbol, path in [f for m in messages if m for f in m.files]:
            system.move(path, f"{top}/{symbol}.csv")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.options["path"])
        for _, path in [f for m in messages if m for f in m.files]:
            system.delete_file(path)


class CsvBars(DataSource):
    """A folder of ``SYMBOL.csv`` files. ``place`` is a line's place in its file, so that ``bars.report`` can tell whether a
    file is in the order of time. Columns go by the names of ``files.ALIASES``; a missing one, or a time that can't be read,
    fails the read; numbers that can't be read, and cells that a short line lacks, are null; empty lines are skipped. A
    header alone gives no rows. Quoted cells may hold line ends. A task holds ``LINES`` lines."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_csv"

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> DataSourceReader:
        return CsvReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return CsvWriter(self.options, schema.names)


class AnswerReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        if not self.wanted:
            raise IngestionError("symbols are needed")
        return [OneSymbol(s) for s in sorted(self.wanted)]

    def read(self, partition: OneSymbol) -> Iterator[tuple]:
        if partition.symbol:
            params = files.vendor_params(partition.symbol, self.options.get("interval", "1d"), self.options.get("key", ""))
            yield partition.symbol, files.answer(self.options["url"], params, wait=float(self.options.get("wait", files.WAIT))), datetime.now(timezone.utc).replace(tzinfo=None)


class Answers(DataSource):
    """A vendor's answers, a request for each symbol, sent by the task that reads it and tried again as ``files.answer`` says.
    Options: ``url``, ``symbols`` (with commas), ``key``, ``interval`` (1d), ``wait`` (2 seconds). Each read asks anew, so keep
    the rows when they are used twice. ``files.parse_vendor_json`` makes bars of them."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_answers"

    def schema(self) -> str:
        return "symbol string, body string, asked_at timestamp_ntz"

    def reader(self, schema) -> DataSourceReader:
        return AnswerReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    for source in (CsvBars, Answers):
        spark.dataSource.register(source)


def csv_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    register(spark)
    options = {"symbols": ",".join(symbols or []), "start": start or "", "end": end or ""}
    return spark.read.format("tidemark_csv").options(**options).load(path)


def write_csv(bars: DataFrame, path: str) -> None:
    """Bars as ``SYMBOL.csv`` files in the order of time, in the place of files of the same symbols. A symbol's rows are
    streamed to its file by one task; no task holds them."""
    register(bars.sparkSession)
    names = [f.split(" ")[0] for f in BARS.split(", ")][:7]
    rows = bars.select(*names).repartition("symbol").sortWithinPartitions("symbol", "ts")
    rows.write.format("tidemark_csv").mode("append").save(path)


class CsvFormat:
    """The folder as a source (``files.Source``): symbols and range reach the tasks, times must be in order if ``ordered``."""

    def __init__(self, spark: SparkSession, path: str, fill: str = "ffill", ordered: bool = False):
        self.spark, self.path, self.fill, self.ordered = spark, path, fill, ordered

    def symbols(self) -> list[str]:
        return sorted(CsvReader({"path": self.path})._files()[1].values())

    def fetch(self, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, interval: str = "1d") -> DataFrame:
        made = kept(csv_bars(self.spark, self.path, symbols, start, end))  # read once
        if made.isEmpty():
            raise IngestionError("no bars in the range")
        if self.ordered:
            bar_ops.checked(made, place="place")
        made = bar_ops.fill(made.drop("place"), self.fill)
        return bar_ops.checked(made if interval == files.DAILY_ONLY else bar_ops.resample(made, interval))
