"""Rolling order statistics: exact quantiles of the last n rows, and means of what lies at or below them.

A batch of a series, with the n - 1 rows before it, is put into a wavelet matrix: its values' ranks, split bit by bit, with
running counts and sums at each bit. The k-th smallest value of any run of rows, and the number and sum of its values below
a rank, then take one look-up a bit, for all rows of the batch at once. So no frame is sorted, and the cost of a row doesn't
depend on n. Rows of one series may be dealt out in segments (see ``segments``), each with the rows before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions import segments
from tidemark.operators import folds


#: A place among sorted values that is this close to a whole number is that number.
EXACT = 1e-9


@dataclass(frozen=True)
class Rolling:
    """Of the last ``n`` rows, where at least ``least`` values (one, at least) are there: the interpolated quantile at
    ``share`` or, with ``tail``, the mean of the values up to it."""

    n: int
    share: float
    least: int
    tail: bool = False

    def __post_init__(self):
        if self.n < 1 or not 0 <= self.share <= 1:
            raise ValueError("a frame has a row at least, and a share lies between 0 and 1")


class Wavelet:
    """Order statistics of runs of ``values`` (no missing ones)."""

    def __init__(self, values: np.ndarray):
        self.distinct, rank = np.unique(values, return_inverse=True)
        self.bits = max(1, int(len(self.distinct) - 1).bit_length())
        self.sums = np.concatenate([[0.0], np.cumsum(values)])
        self.levels = []
        for b in reversed(range(self.bits)):
            zero = (rank >> b) & 1 == 0
            zeros = np.concatenate([[0], np.cumsum(zero)])
            self.levels.append((b, zeros, np.concatenate([[0.0], np.cumsum(np.where(zero, values, 0.0))])))
            order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
            rank, values = rank[order], values[order]

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of values[lo:hi]."""
        found = np.zeros(len(lo), np.int64)
        for b, zeros, _ in self.levels:
            a, z = zeros[lo], zeros[hi]
            one = k >= z - a
            found |= one.astype(np.int64) << b
            k = np.where(one, k - (z - a), k)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - z, z)
        return self.distinct[found]

    def up_to(self, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the values of values[lo:hi] up to a limit."""
        rank = np.searchsorted(self.distinct, limit, "right")
        whole = rank >= len(self.distinct)
        n, total = np.where(whole, hi - lo, 0), np.where(whole, self.sums[hi] - self.sums[lo], 0.0)
        rank = np.where(whole, 0, rank)
        for b, zeros, sums in self.levels:
            a, z = zeros[lo], zeros[hi]
            one = (rank >> b) & 1 == 1
            n, total = n + np.where(one, z - a, 0), total + np.where(one, sums[hi] - sums[lo], 0.0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - z, z)
        return n, total


def rolled(values: np.ndarray, at: int, wanted: list[Rolling]) -> list[np.ndarray]:
    """Statistics of the frames that end at ``at`` and after it; missing values (NaN) are passed over."""
    there = ~np.isnan(values)
    before = np.concatenate([[0], np.cumsum(there)])
    ends = np.arange(at, len(values))
    held = Wavelet(values[there]) if there.any() else None
    out = []
    for w in wanted:
        made = np.full(len(ends), np.nan)
        lo, hi = before[np.maximum(ends - w.n + 1, 0)], before[ends + 1]
        full = np.flatnonzero(hi - lo >= max(w.least, 1))
        if held is not None and len(full):
            lo, hi = lo[full], hi[full]
            place = w.share * (hi - lo - 1)
            # 1 - 0.9 is a little less than 0.1, and would miss the value that it means.
            place = np.where(np.abs(place - np.rint(place)) < EXACT, np.rint(place), place)
            k = np.floor(place).astype(np.int64)
            low = held.kth(lo, hi, k)
            limit = low + (place - k) * (held.kth(lo, hi, np.minimum(k + 1, hi - lo - 1)) - low)
            if w.tail:
                n, total = held.up_to(lo, hi, limit)
                made[full] = total / n
            else:
                made[full] = limit
        out.append(made)
    return out


class _Frames:
    """The last rows of a series, as the next batch's frames need them."""

    def __init__(self, column: str, wanted: dict[str, Rolling]):
        self.column, self.wanted, self.back = column, wanted, max(w.n for w in wanted.values()) - 1
        self.held = np.zeros(0)

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([self.held, rows[self.column].to_numpy(np.float64, na_value=np.nan)])
        made = rolled(values, len(self.held), list(self.wanted.values()))
        self.held = values[max(0, len(values) - self.back) :] if self.back else np.zeros(0)
        return pd.DataFrame({name: pd.Series(pd.array(x, "Float64"), rows.index) for name, x in zip(self.wanted, made, strict=True)})


def rolling(df: DataFrame, column: str, wanted: dict[str, Rolling], keys: list[str], order: list[str], segment: int | None = None) -> DataFrame:
    """Adds rolling order statistics of a column. Nulls (and NaN) are passed over; a frame with too few values gives null.
    ``segment``: rows of a series that go to a task together (the longest frame, at least); all, if None."""
    added = ", ".join(f"`{name}` double" for name in wanted)
    start = lambda _: _Frames(column, wanted)
    if segment is None:
        return folds.fold(df, keys, order, start, added)
    back = max(w.n for w in wanted.values()) - 1
    cut = segments.overlapping(segments.numbered(df, keys, order), segment, back)
    made = folds.fold(cut, [*keys, segments.SEGMENT], [segments.ROW], start, added)
    return made.where(~made[segments.AHEAD]).select(*df.columns, *wanted)


def with_risk(df: DataFrame, column: str, keys: list[str], order: list[str], n: int = 252, confidence: float = 0.95, least: int | None = None, segment: int | None = None) -> DataFrame:
    """Adds ``var`` and ``cvar``: the loss at a percentile of the last n values, and the mean loss from there on; half of the
    frame (by default) must be there."""
    share, least = 1 - confidence, n // 2 if least is None else least
    made = rolling(df, column, {"var": Rolling(n, share, least), "cvar": Rolling(n, share, least, True)}, keys, order, segment)
    return made.withColumns({c: -made[c] for c in ("var", "cvar")})
