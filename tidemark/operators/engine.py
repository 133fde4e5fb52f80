"""Back-tests: signals to orders, fills, cash and equity, for many runs and symbols at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigurationError
from tidemark.functions import series
from tidemark.operators import folds, metrics


@dataclass(frozen=True)
class Costs:
    """Capital and costs of a run. Costs are shares of a price (0.0005 is five basis points)."""

    capital: float = 100_000.0
    commission: float = 0.0005
    slippage: float = 0.0002
    max_position: float = 0.25
    allow_short: bool = False
    #: Slippage both moves the fill price and is charged in cash.
    double_slippage: bool = True
    #: Bars between a signal and its fill at the open.
    fill_lag: int = 0

    def __post_init__(self):
        if self.capital <= 0 or min(self.commission, self.slippage) < 0 or self.fill_lag < 0:
            raise ConfigurationError("capital must be positive; costs and lag must not be negative")


# The least order, the least position, and what an order may take of the cash (price with a margin; part of it).
LEAST_ORDER, LEAST_POSITION, CASH_MARGIN, CASH_PART = 1e-6, 1e-8, 1.001, 0.99


class Accounts:
    """Cash and positions of many runs, one a slot; each step takes the next bar of some of them."""

    FIELDS = ("cash", "qty", "avg_cost", "episode", "equity")

    def __init__(self, costs: Costs):
        self.c = costs
        for f in self.FIELDS:
            setattr(self, f, np.zeros(0))

    def grow(self, n: int) -> None:
        for f in self.FIELDS:
            setattr(self, f, np.concatenate([getattr(self, f), np.full(n, {"cash": self.c.capital, "equity": np.nan}.get(f, 0.0))]))

    def orders(self, direction: np.ndarray, close: np.ndarray, cash: np.ndarray, qty: np.ndarray) -> np.ndarray:
        """Signed quantities that move positions to their targets."""
        priced = close > 0
        close = np.where(priced, close, 1.0)
        target = (cash + qty * close) * self.c.max_position / close * direction
        delta = (target if self.c.allow_short else np.maximum(target, 0.0)) - qty
        part = cash * CASH_PART / close
        part = np.where(part < LEAST_ORDER, 0.0, part)
        bought = np.where((delta > 0) & (delta * close * CASH_MARGIN > cash), part, delta)
        return np.where(priced & (np.abs(delta) >= LEAST_ORDER), bought, 0.0)

    def step(self, slots: np.ndarray, direction: np.ndarray, price: np.ndarray, close: np.ndarray) -> list[np.ndarray]:
        c, cash, qty, avg = self.c, self.cash[slots], self.qty[slots], self.avg_cost[slots]
        delta = self.orders(np.nan_to_num(direction), close, cash, qty)
        delta = np.where(price > 0, delta, 0.0)
        traded = delta != 0
        price = np.where(traded, price, 0.0)
        fill = np.where(delta > 0, price * (1 + c.slippage), price * (1 - c.slippage))
        slip, fee = price * c.slippage * np.abs(delta), fill * np.abs(delta) * c.commission
        episode = self.episode[slots] + (traded & (qty == 0))
        held = qty + delta
        mean = np.divide(qty * avg + delta * fill, held, out=avg.copy(), where=(delta > 0) & (held != 0))
        closed = traded & (np.abs(held) < LEAST_POSITION)
        held, mean = np.where(closed, 0.0, held), np.where(closed, 0.0, mean)
        cash = np.where(traded, cash - (delta * fill + fee + (slip if c.double_slippage else 0.0)), cash)
        equity, before = cash + held * close, self.equity[slots]
        self.cash[slots], self.qty[slots], self.avg_cost[slots], self.episode[slots], self.equity[slots] = cash, held, mean, episode, equity
        r = np.divide(equity, before, out=np.full(len(before), np.nan), where=before != 0) - 1
        return [delta, fill, fee, slip, cash, held, mean, held * (close - mean), equity, r, episode]


_ADDED = [*((c, "double") for c in ("traded", "fill_price", "commission", "slippage", "cash", "qty", "avg_cost", "unrealised", "equity", "r")), ("episode", "long")]


def run(signals: DataFrame, costs: Costs = Costs(), keys: list[str] = ["symbol"], semantics: str = "corrected") -> DataFrame:  # noqa: B006,B008
    """One row for each bar with a signal: the bar, ``traded`` (signed), ``fill_price``, ``commission``, ``slippage``,
    ``cash``, ``qty``, ``avg_cost`` (that of what was bought; a short has none), ``unrealised`` gain at the close, ``equity``
    and ``r``, the return of equity since the bar before.

    Orders are sized at the bar's close and filled at the open ``fill_lag`` bars later; an open that is missing or not
    positive fills nothing. ``corrected`` equity is cash and position at the close. ``reference`` values every bar of
    a position with the quantity that it had last, and nothing once it is closed. All runs of a task go bar by bar side by
    side, each step one of arrays.
    """
    if semantics not in ("corrected", "reference"):
        raise ConfigurationError(f"unknown semantics {semantics!r}")
    w = Window.partitionBy(*keys).orderBy("ts")
    filled = F.lead("open", costs.fill_lag).over(w) if costs.fill_lag else F.col("open")
    ready = signals.withColumn("_fill_open", filled)
    made = folds.side_by_side(ready, keys, ["ts"], [F.col("direction"), F.col("_fill_open"), F.col("close")], lambda: Accounts(costs), _ADDED).drop("_fill_open")
    if semantics == "reference":
        episode = Window.partitionBy(*keys, "episode").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        held = F.when(F.col("qty") == 0, F.lit(0.0)).otherwise(F.last("qty").over(episode))
        made = made.withColumn("equity", F.col("cash") + held * F.col("close"))
        made = made.withColumn("r", series.change(F.col("equity"), w))
    return made.drop("episode")


def fills(runs: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:  # noqa: B006
    """The rows that traded: ``side``, ``quantity`` and costs."""
    side = F.when(F.col("traded") > 0, F.lit("BUY")).otherwise(F.lit("SELL"))
    return runs.where(F.col("traded") != 0).select(*keys, "ts", side.alias("side"), F.abs("traded").alias("quantity"), "fill_price", "commission", "slippage")


def performance(runs: DataFrame, keys: list[str] = ["symbol"], **options) -> DataFrame:  # noqa: B006
    """All metrics of each run's equity."""
    return metrics.compute(runs, keys, equity="equity", **options)


def exposure(runs: DataFrame) -> DataFrame:
    """Adds gross and net exposure at the close."""
    net = F.col("qty") * F.col("close")
    return runs.withColumn("net_exposure", net).withColumn("gross_exposure", F.abs(net))


def combined(runs: DataFrame) -> DataFrame:
    """Equity of all symbols together, at times at which all have a bar."""
    n = runs.select("symbol").distinct().agg(F.count(F.lit(1)).alias("_symbols"))
    sums = runs.groupBy("ts").agg(F.sum("equity").alias("equity"), F.count(F.lit(1)).alias("_bars"))
    return sums.join(F.broadcast(n), F.col("_bars") == F.col("_symbols")).select("ts", "equity")  # one row
