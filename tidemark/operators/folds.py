"""Sequential folds over ordered series, for recurrences that no built-in expression has.

Rows are dealt out by key and sorted, and each task streams its rows: of a series only the fold's state is held, never
its rows, and a task takes one batch at a time. ``fold`` takes one series after the other; ``side_by_side`` takes the first
row of all of a task's series, then the second of all, so that one step of arrays moves all of them on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Fold(Protocol):
    """State of one series. ``step`` gets the next rows of it, in order, and returns the columns to add."""

    def step(self, rows: pd.DataFrame) -> pd.DataFrame: ...


class States(Protocol):
    """States of many series, one a slot. ``step`` gets the next row of those in ``slots``, as an array for each input, and
    returns the columns to add (NaN is null)."""

    def grow(self, n: int) -> None: ...

    def step(self, slots: np.ndarray, *inputs: np.ndarray) -> list[np.ndarray]: ...


def side_by_side(df: DataFrame, keys: list[str], order: list[str], inputs: list[Column], start: Callable[[], States], added: list[tuple[str, str]]) -> DataFrame:
    """Adds to each row the columns (name, type) that the step of its series gives for it. ``inputs`` are doubles, with NaN
    for null. A step's rows are in the order of their keys, and a series knows its length, so that the place of a row among
    those of its step tells its series. A task holds the states of its series, and one batch of rows."""
    w = Window.partitionBy(*keys)
    df_names, n_inputs = df.columns, len(inputs)
    named = [c.cast("double").alias(f"_in{k}") for k, c in enumerate(inputs)]
    rows = df.select("*", *named, F.row_number().over(w.orderBy(*order)).alias("_step"), F.count(F.lit(1)).over(w).alias("_n"))
    rows = rows.sortWithinPartitions("_step", *keys)
    width = len(df.columns)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{name}` {kind}" for name, kind in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, lengths, now, alive, seen = start(), np.zeros(0, np.int64), 1, np.zeros(0, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            step, n = (batch.column(c).to_numpy() for c in ("_step", "_n"))
            given = [batch.column(f"_in{k}").to_numpy(zero_copy_only=False) for k in range(n_inputs)]
            made = [np.empty(batch.num_rows) for _ in added]
            cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if step[lo] == 1:
                    slots = np.arange(len(lengths), len(lengths) + hi - lo)
                    lengths = np.concatenate([lengths, n[lo:hi]])
                    states.grow(hi - lo)
                else:
                    if step[lo] != now:
                        now, alive, seen = step[lo], np.flatnonzero(lengths >= step[lo]), 0
                    slots = alive[seen : seen + hi - lo]
                    seen += hi - lo
                for out, x in zip(made, states.step(slots, *(g[lo:hi] for g in given)), strict=True):
                    out[lo:hi] = x
            columns = [pa.array(x, from_pandas=True).cast(pa.int64()) if kind == "long" else pa.array(x, from_pandas=True) for x, (_, kind) in zip(made, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], names=[*df_names, *(name for name, _ in added)])

    return rows.mapInArrow(run, kinds)


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[tuple], Fold], added: str) -> DataFrame:
    """Adds to each row what the fold of its series returns for it. ``start`` makes the state for a key's values; the
    fold may return fewer rows than it got, with the index of those it keeps. Null keys make a series of their own."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for batch in batches:
            if not len(batch):
                continue
            codes = np.zeros(len(batch), bool)
            for k in keys:
                now, before = batch[k], batch[k].shift()
                codes |= ((now != before) & ~(now.isna() & before.isna())).to_numpy()
            codes[0] = True
            cuts = [*np.flatnonzero(codes), len(batch)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                rows = batch.iloc[lo:hi]
                key = tuple(None if pd.isna(v) else v for v in rows[keys].iloc[0])
                if key != at:
                    at, state = key, start(key)
                made = state.step(rows)
                yield pd.concat([rows.loc[made.index, names], made], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, {added}")
