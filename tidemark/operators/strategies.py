"""Signals: bars in, bars with ``direction`` (-1, 0, 1) and ``strength`` out, for all symbols at once.

Each strategy says how many bars it needs; signals start after those (``warm`` bars have none), and state starts flat
there. Own strategies are registered as classes with ``needs`` and ``signals``.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import StrategyError
from tidemark.functions import series
from tidemark.operators import folds

KEYS = ["symbol"]


def numbered(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``i``, each bar's place in its series, from 0."""
    return bars.withColumn("i", F.row_number().over(series.ordered(keys, "ts")) - 1)


@dataclass(frozen=True)
class Strategy:
    """Parameters of a rule. ``keys`` tell series apart: runs of a grid, windows and symbols."""

    def needs(self) -> int:
        raise NotImplementedError

    def signals(self, bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
        raise NotImplementedError

    @classmethod
    def grid_signals(cls, rows: DataFrame, keys: list[str], most: dict[str, float]) -> DataFrame | None:
        """``signals`` of many parameter sets in one plan: ``rows`` are numbered bars (``i``), once for each set, with its
        parameters as columns ``p_<name>``; ``most`` has the greatest of each. None if a rule has no such form."""
        return None

    def params(self) -> dict:
        return asdict(self)

    def with_params(self, **params) -> Strategy:
        """The same rule with other parameters; unknown names are left out."""
        return replace(self, **{k: v for k, v in params.items() if k in asdict(self)})


# Days of a year, and how far strengths reach in momentum and in breakouts.
YEAR, MOST_MOMENTUM, MOST_BREAKOUT = 252, 3.0, 5.0


def _clip(c, most: float):
    return F.greatest(F.lit(-most), F.least(F.lit(most), c))


@dataclass(frozen=True)
class MovingAverageCrossover(Strategy):
    """Long from when the fast average crosses over the slow one until it crosses back (then short, if allowed)."""

    fast: int = 20
    slow: int = 50
    short: bool = False

    def __post_init__(self):
        if self.fast >= self.slow:
            raise StrategyError("fast must be less than slow")

    def needs(self) -> int:
        return self.slow + 1

    def signals(self, bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
        made = series.ema(numbered(bars, keys), {"_f": ("close", series.span_alpha(self.fast)), "_s": ("close", series.span_alpha(self.slow))}, keys, "ts")
        w = series.ordered(keys, "ts")
        up = (F.lag("_f").over(w) <= F.lag("_s").over(w)) & (F.col("_f") > F.col("_s"))
        down = (F.lag("_f").over(w) >= F.lag("_s").over(w)) & (F.col("_f") < F.col("_s"))
        made = made.withColumn("_e", F.when(F.col("i") < self.needs(), F.lit(None)).when(up, F.lit(1)).when(down, F.lit(-1 if self.short else 0)))
        made = made.withColumn("direction", F.coalesce(F.last("_e", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
        made = made.withColumn("strength", series.ratio(F.col("_f") - F.col("_s"), F.col("_s")))
        return made.where(F.col("i") >= self.needs()).drop("_f", "_s", "_e", "i")

    @classmethod
    def grid_signals(cls, rows: DataFrame, keys: list[str], most: dict[str, float]) -> DataFrame:
        inputs = [F.col("close"), F.col("i"), *[F.col(f"p_{c}") for c in ("fast", "slow", "short")]]
        made = folds.side_by_side(rows, keys, ["i"], inputs, _Crossings, [("direction", "long"), ("strength", "double")])
        return made.where("i >= p_slow + 1").withColumn("direction", F.col("direction").cast("int"))


class _Slots:
    """Arrays of states, a number for each series and name; NaN at first."""

    NAMES: tuple[str, ...] = ()

    def __init__(self):
        self.state = np.zeros((len(self.NAMES), 0))

    def grow(self, n: int) -> None:
        self.state = np.concatenate([self.state, np.full((len(self.NAMES), n), np.nan)], axis=1)


def _average(x: np.ndarray, before: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The next exponential average; missing values keep it."""
    alpha = 2 / (span + 1)
    made = np.where(np.isnan(before), x, alpha * x + (1 - alpha) * before)
    return np.where(np.isnan(x), before, made)


class _Crossings(_Slots):
    NAMES = ("fast", "slow", "direction")

    def step(self, slots: np.ndarray, close: np.ndarray, i: np.ndarray, fast: np.ndarray, slow: np.ndarray, short: np.ndarray) -> list[np.ndarray]:
        f0, s0, held = self.state[:, slots]
        f, s = _average(close, f0, fast), _average(close, s0, slow)
        ready = i >= slow + 1
        held = np.where(ready & (f0 <= s0) & (f > s), 1.0, np.where(ready & (f0 >= s0) & (f < s), -short, np.nan_to_num(held)))
        self.state[:, slots] = f, s, held
        return [held + 0.0, np.divide(f - s, s, out=np.full(len(s), np.nan), where=s != 0)]


class _Average(_Slots):
    NAMES = ("average",)

    def step(self, slots: np.ndarray, x: np.ndarray, span: np.ndarray) -> list[np.ndarray]:
        self.state[0, slots] = _average(x, self.state[0, slots], span)
        return [self.state[0, slots]]


class _Reversions(_Slots):
    """As ``_Reversion``, for many series."""

    NAMES = ("state",)

    def step(self, slots: np.ndarray, z: np.ndarray, entry: np.ndarray, exit_: np.ndarray, short: np.ndarray) -> list[np.ndarray]:
        state, known = np.nan_to_num(self.state[0, slots]), ~np.isnan(z)
        over = (state == 1) & (z > exit_) | (state == -1) & (z < -exit_)
        new = np.where(over, 0.0, np.where(z < -entry, 1.0, np.where((z > entry) & (short > 0), -1.0, state)))
        self.state[0, slots] = np.where(known, new, state)
        return [np.where(known, new, 0.0)]


class _Reversion:
    def __init__(self, entry: float, exit_: float, short: bool):
        self.entry, self.exit, self.short, self.state = entry, exit_, short, 0

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for z in rows["z"]:
            if pd.isna(z):
                out.append(0)
                continue
            if self.state == 1 and z > self.exit or self.state == -1 and z < -self.exit:
                self.state = 0
            elif z < -self.entry:
                self.state = 1
            elif z > self.entry and self.short:
                self.state = -1
            out.append(self.state)
        return pd.DataFrame({"direction": pd.array(out, "int32")}, index=rows.index)


@dataclass(frozen=True)
class MeanReversion(Strategy):
    """In when the z-score is beyond entry, against it; out when it is beyond exit on the other side. A short is left
    flat on the bar that ends it, also if that bar is beyond entry. Bars without deviation are flat, but keep state."""

    lookback: int = 30
    entry: float = 2.0
    exit: float = 0.5
    short: bool = True

    def __post_init__(self):
        if self.entry <= self.exit:
            raise StrategyError("entry must be greater than exit")

    def needs(self) -> int:
        return self.lookback + 1

    def signals(self, bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
        w = series.ordered(keys, "ts")
        mean, dev = series.rolling_mean(F.col("close"), w, self.lookback), series.rolling_deviation(F.col("close"), w, self.lookback)
        made = numbered(bars, keys).withColumn("z", (F.col("close") - mean) / F.nullif(dev, F.lit(0.0))).where(F.col("i") >= self.needs()).drop("i")
        made = made.withColumn("strength", F.coalesce(-F.col("z") / self.entry, F.lit(0.0)))
        if self.short:
            return folds.fold(made, keys, ["ts"], lambda _: _Reversion(self.entry, self.exit, True), "direction int").drop("z")
        event = F.when(F.col("z") < -self.entry, F.lit(1)).when(F.col("z") > self.exit, F.lit(0))
        held = F.coalesce(F.last(event, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        return made.withColumn("direction", F.when(F.col("z").isNull(), F.lit(0)).otherwise(held)).drop("z")

    @classmethod
    def grid_signals(cls, rows: DataFrame, keys: list[str], most: dict[str, float]) -> DataFrame:
        made = series.rolling_by(rows, "close", "p_lookback", keys, most["lookback"], "_m", "_d")
        made = made.withColumn("z", (F.col("close") - F.col("_m")) / F.nullif(F.col("_d"), F.lit(0.0))).where("i >= p_lookback + 1")
        made = made.withColumn("strength", F.coalesce(-F.col("z") / F.col("p_entry"), F.lit(0.0)))
        inputs = [F.col(c) for c in ("z", "p_entry", "p_exit", "p_short")]
        made = folds.side_by_side(made, keys, ["i"], inputs, _Reversions, [("direction", "long")])
        return made.withColumn("direction", F.col("direction").cast("int")).drop("z", "_m", "_d")


@dataclass(frozen=True)
class Momentum(Strategy):
    """With the sign of the return over the lookback; strength is that return per volatility, within 3 either way."""

    lookback: int = 63
    vol_window: int = 21
    scaled: bool = True
    short: bool = True

    def needs(self) -> int:
        return max(self.lookback, self.vol_window) + 1

    def signals(self, bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
        w = series.ordered(keys, "ts")
        made = numbered(bars, keys).withColumn("_l", series.log_change(F.col("close"), w)).withColumn("_r", series.change(F.col("close"), w, self.lookback))
        made = made.withColumn("_v", series.rolling_deviation(F.col("_l"), w, self.vol_window) * YEAR**0.5).where(F.col("i") >= self.needs())
        sign = F.signum("_r").cast("int")
        sign = F.coalesce(sign, F.lit(0))
        direction = sign if self.short else F.greatest(sign, F.lit(0))
        strength = F.when(F.lit(self.scaled) & (F.col("_v") > 0), F.col("_r") / F.col("_v")).otherwise(F.coalesce(F.signum("_r"), F.lit(0.0)))
        return made.withColumn("direction", direction).withColumn("strength", _clip(strength, MOST_MOMENTUM)).drop("_l", "_r", "_v", "i")

    @classmethod
    def grid_signals(cls, rows: DataFrame, keys: list[str], most: dict[str, float]) -> DataFrame:
        made = rows.withColumn("_l", series.log_change(F.col("close"), series.ordered(keys, "i")))
        made = series.rolling_by(made, "_l", "p_vol_window", keys, most["vol_window"], "_m", "_d")
        made = made.withColumn("_b", series.lag_by("close", "p_lookback", keys, most["lookback"]))
        made = made.withColumn("_r", series.ratio(F.col("close"), F.col("_b")) - 1).withColumn("_v", F.col("_d") * YEAR**0.5)
        made = made.where("i >= greatest(p_lookback, p_vol_window) + 1")
        sign = F.coalesce(F.signum("_r").cast("int"), F.lit(0))
        strength = F.when(F.col("p_scaled") & (F.col("_v") > 0), F.col("_r") / F.col("_v")).otherwise(F.coalesce(F.signum("_r"), F.lit(0.0)))
        made = made.withColumn("direction", F.when(F.col("p_short"), sign).otherwise(F.greatest(sign, F.lit(0))))
        return made.withColumn("strength", _clip(strength, MOST_MOMENTUM)).drop("_l", "_m", "_d", "_b", "_r", "_v")


@dataclass(frozen=True)
class VolatilityBreakout(Strategy):
    """Long above the upper band, flat (or short) below the lower, else flat; strength is the distance in true ranges."""

    bands: int = 20
    width: float = 2.0
    atr: int = 14
    short: bool = False

    def needs(self) -> int:
        return max(self.bands, self.atr) + 1

    def signals(self, bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
        w = series.ordered(keys, "ts")
        made = series.with_atr(numbered(bars, keys), self.atr, keys, "ts", "_atr")
        made = made.withColumn("_m", series.rolling_mean(F.col("close"), w, self.bands)).withColumn("_d", series.rolling_deviation(F.col("close"), w, self.bands))
        made = made.where(F.col("i") >= self.needs())
        direction = F.when(F.col("close") > F.col("_m") + self.width * F.col("_d"), F.lit(1)).when(F.col("close") < F.col("_m") - self.width * F.col("_d"), F.lit(-1 if self.short else 0)).otherwise(F.lit(0))
        strength = F.when(F.col("_atr") > 0, _clip((F.col("close") - F.col("_m")) / F.col("_atr"), MOST_BREAKOUT)).otherwise(F.lit(0.0))
        return made.withColumn("direction", direction).withColumn("strength", strength).drop("_m", "_d", "_atr", "i")

    @classmethod
    def grid_signals(cls, rows: DataFrame, keys: list[str], most: dict[str, float]) -> DataFrame:
        made = rows.withColumn("_tr", series.true_range(series.ordered(keys, "i")))
        made = folds.side_by_side(made, keys, ["i"], [F.col("_tr"), F.col("p_atr")], _Average, [("_atr", "double")])
        made = series.rolling_by(made, "close", "p_bands", keys, most["bands"], "_m", "_d").where("i >= greatest(p_bands, p_atr) + 1")
        above, below = (F.col("close") > F.col("_m") + F.col("p_width") * F.col("_d"), F.col("close") < F.col("_m") - F.col("p_width") * F.col("_d"))
        direction = F.when(above, F.lit(1)).when(below, -F.col("p_short").cast("int")).otherwise(F.lit(0))
        strength = F.when(F.col("_atr") > 0, _clip((F.col("close") - F.col("_m")) / F.col("_atr"), MOST_BREAKOUT)).otherwise(F.lit(0.0))
        return made.withColumn("direction", direction).withColumn("strength", strength).drop("_m", "_d", "_atr", "_tr")


_known: dict[str, type[Strategy]] = {"ma_crossover": MovingAverageCrossover, "mean_reversion": MeanReversion, "momentum": Momentum, "volatility_breakout": VolatilityBreakout}


def register(name: str, strategy: type[Strategy]) -> None:
    if not (isinstance(strategy, type) and issubclass(strategy, Strategy)):
        raise TypeError("a strategy must derive from Strategy")
    _known[name] = strategy


def get(name: str, **params) -> Strategy:
    if name not in _known:
        raise KeyError(f"unknown strategy {name!r}; known: {names()}")
    return _known[name](**params)


def grid_signals(bars: DataFrame, name: str, params: list[dict], keys: list[str]) -> DataFrame:
    """Signals of all parameter sets, on bars that are there once for each set: ``grid`` (one of ``keys``) is the set's
    place in the list. Sets are rows of a table, so that the plan is the same for any number of them, unless a rule of one's
    own can only be planned one set at a time."""
    rules = [get(name, **p) for p in params]
    fields = list(rules[0].params())
    kinds = {bool: "boolean", int: "long", float: "double"}
    kind = lambda c: kinds[max((type(r.params()[c]) for r in rules), key=list(kinds).index)]
    table = bars.sparkSession.createDataFrame([(k, *(float(v) if kind(c) == "double" else v for c, v in r.params().items())) for k, r in enumerate(rules)], ", ".join(["grid int", *(f"p_{c} {kind(c)}" for c in fields)]))
    # One row a set, all of which were listed by the caller.
    rows = numbered(bars, keys).join(F.broadcast(table), "grid").select(*bars.columns, "i", *[f"p_{c}" for c in fields])
    most = {c: max(r.params()[c] for r in rules) for c in fields}
    made = type(rules[0]).grid_signals(rows, keys, most)
    if made is None:
        made = reduce(DataFrame.unionByName, [r.signals(bars.where(F.col("grid") == k), keys) for k, r in enumerate(rules)])
    return made.select(*bars.columns, "direction", "strength")


def names() -> list[str]:
    return sorted(_known)
