"""Bars, running portfolios and running strategies of live streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.operators import engine, strategies
from tidemark.sources.store import Store


def bars(ticks: DataFrame, symbol: str, ts: str, price: str, interval: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of a stream of prices, each given out once the watermark has passed it; later ticks are dropped."""
    at = F.struct(F.col(ts), F.col(price))
    made = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = made.groupBy(F.col(symbol).alias("symbol"), F.window(ts, interval).alias("w")).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(price).alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def keep_up_to_date(stream: DataFrame, held: Store, interval: str, longer: list[str]) -> DataStreamWriter:
    """Writes a stream of bars to the store, and makes the longer bars again that its micro-batches touch, however late their
    rows are. A batch that is sent again after a failure changes nothing. Set a checkpoint and a trigger, and start it."""
    return stream.writeStream.foreachBatch(lambda rows, _: held.add(rows, interval, longer) and None)


class _Run:
    """The account of one symbol and, with a rule, the rule's averages, as numbers that a state store keeps."""

    def __init__(self, costs: engine.Costs, rule: strategies.MovingAverageCrossover | None, kept: list[float] | None):
        self.account, self.rule, self.signals, self.i = engine.Accounts(costs), rule, strategies._Crossings(), 0
        self.account.grow(1)
        self.signals.grow(1)
        if kept:
            n = len(self.account.FIELDS)
            for f, v in zip(self.account.FIELDS, kept[:n], strict=True):
                getattr(self.account, f)[0] = v
            self.signals.state[:, 0], self.i = kept[n:-1], int(kept[-1])

    def numbers(self) -> list[float]:
        return [*(float(getattr(self.account, f)[0]) for f in self.account.FIELDS), *self.signals.state[:, 0].tolist(), float(self.i)]

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        """What each bar leaves, of those that have a signal."""
        slot, at, out, keep = np.zeros(1, np.int64), {name: k for k, (name, _) in enumerate(engine._ADDED)}, [], []
        one = lambda x: np.array([x], np.float64)
        for k, r in enumerate(rows.itertuples(index=False)):
            if self.rule is None:
                direction = one(r.direction)
            else:
                direction, _ = self.signals.step(slot, one(r.close), one(self.i), *(one(getattr(self.rule, c)) for c in ("fast", "slow", "short")))
                self.i += 1
                if self.i <= self.rule.needs():
                    continue
            made = self.account.step(slot, direction, one(r.open), one(r.close))
            out.append([direction[0], *(made[at[c]][0] for c in ("cash", "qty", "equity"))])
            keep.append(k)
        made = pd.DataFrame(out, columns=["direction", "cash", "qty", "equity"], dtype=np.float64)
        return pd.concat([rows[["ts"]].iloc[keep].reset_index(drop=True), made], axis=1)


_OUT = "symbol string, ts timestamp, direction double, cash double, qty double, equity double"
_KEPT = "numbers array<double>, ts array<timestamp>, open array<double>, close array<double>"


def portfolio(signals: DataFrame, costs: engine.Costs = engine.Costs()) -> DataFrame:  # noqa: B008
    """Cash, position and equity after each bar of a stream of ``symbol, ts, open, close, direction``; the account of a
    symbol is kept in the state store. Bars of one micro-batch are taken in the order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = _Run(costs, None, list(state.get[0]) if state.exists else None)
        made = run.step(pd.concat(list(batches)).sort_values("ts", kind="stable"))
        state.update((run.numbers(), [], [], []))
        made.insert(0, "symbol", key[0])
        yield made

    return signals.groupBy("symbol").applyInPandasWithState(step, _OUT, _KEPT, "append", GroupStateTimeout.NoTimeout)


def crossover(bars_: DataFrame, rule: strategies.MovingAverageCrossover = strategies.MovingAverageCrossover(), costs: engine.Costs = engine.Costs(), late: str = "2 hours") -> DataFrame:  # noqa: B008
    """The moving average crossover and its account on a stream of bars, as a batch of the same bars gives them.

    Bars wait in the state store until the watermark, which stays ``late`` behind the latest bar, has passed them, and then
    are taken in the order of time, in whatever order they came; a timer gives out those after which nothing comes. Bars that
    come behind the watermark are dropped. What is kept of a symbol are its averages, its account and the waiting bars.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        numbers, *waiting = state.get if state.exists else (None, [], [], [])
        held = pd.DataFrame(dict(zip(("ts", "open", "close"), waiting, strict=True)))
        passed = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        new = [b[["ts", "open", "close"]] for b in batches] if not state.hasTimedOut else []
        rows = pd.concat([x for x in (held, *new) if len(x)] or [held]).astype({"ts": "datetime64[ns]", "open": float, "close": float})
        rows = rows.sort_values("ts", kind="stable")
        due, wait = rows[rows["ts"] < passed], rows[rows["ts"] >= passed]
        run = _Run(costs, rule, list(numbers) if numbers is not None else None)
        made = run.step(due)
        state.update((run.numbers(), [t.to_pydatetime() for t in wait["ts"]], wait["open"].tolist(), wait["close"].tolist()))
        if len(wait):
            state.setTimeoutTimestamp(int(wait["ts"].iloc[0].value // 1_000_000) + 1)
        made.insert(0, "symbol", key[0])
        yield made

    watched = bars_.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return watched.groupBy("symbol").applyInPandasWithState(step, _OUT, _KEPT, "append", GroupStateTimeout.EventTimeTimeout)
