"""Operations as functions: settings in, DataFrames out; runs are kept in a store."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ConfigurationError, InsufficientDataError, RiskError, SimulationError, WalkForwardError
from tidemark.functions import orderstat, series
from tidemark.operators import engine, metrics, montecarlo, risk, strategies, walkforward
from tidemark.plans.tables import kept
from tidemark.sources.store import Store


@dataclass(frozen=True)
class Settings:
    """Defaults of all operations. ``from_env`` takes ``TIDEMARK_<NAME>`` from the environment."""

    capital: float = 100_000.0
    commission: float = 0.0005
    slippage: float = 0.0002
    max_position: float = 0.25
    allow_short: bool = False
    risk_free: float = 0.04
    days: int = 252
    train: int = 252
    test: int = 63
    step: int = 21
    n_sims: int = 1000
    horizon: int = 252
    block: int = 10
    seed: int = 42

    @classmethod
    def from_env(cls, env: dict | None = None) -> Settings:
        env = os.environ if env is None else env
        kinds = {"float": float, "int": int, "bool": lambda v: v.lower() in ("1", "true", "yes")}
        try:
            return cls(**{f.name: kinds[f.type](v) for f in fields(cls) if (v := env.get(f"TIDEMARK_{f.name.upper()}")) is not None})
        except ValueError as e:
            raise ConfigurationError(str(e)) from e

    def costs(self) -> engine.Costs:
        return engine.Costs(self.capital, self.commission, self.slippage, self.max_position, self.allow_short)


def run_key(data: DataFrame, asked: dict) -> str:
    """A digest of all rows of the data, in any order, and of what was asked for."""
    columns = sorted(data.columns)
    rows = data.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")), F.bit_xor(F.xxhash64(F.lit(1), *columns))).first()
    return hashlib.sha256(json.dumps({"data": [str(x) for x in rows], "columns": columns, **asked}, sort_keys=True).encode()).hexdigest()[:32]


@dataclass(frozen=True)
class Backtest:
    run_id: str
    equity: DataFrame
    fills: DataFrame
    metrics: DataFrame


@dataclass(frozen=True)
class Service:
    settings: Settings = field(default_factory=Settings)
    store: Store | None = None

    def strategies(self) -> list[str]:
        return strategies.names()

    def backtest(self, bars: DataFrame, strategy: str, params: dict | None = None, semantics: str = "corrected", interval: str = "1d") -> Backtest:
        """Runs a strategy on all symbols; the run's id is a digest of the bars and of what was asked for."""
        rule, s = strategies.get(strategy, **(params or {})), self.settings
        if bars.groupBy("symbol").count().where(F.col("count") > rule.needs()).isEmpty():
            raise InsufficientDataError(f"more than {rule.needs()} bars of a symbol are needed")
        run_id = run_key(bars, {"strategy": strategy, "params": rule.params(), "settings": asdict(s), "semantics": semantics, "interval": interval})
        made = engine.run(rule.signals(bars), s.costs(), semantics=semantics)
        if self.store:
            made = kept(made)  # one fold for equity, fills and metrics
        out = Backtest(run_id, made.select("symbol", "ts", "equity", "r"), engine.fills(made), engine.performance(made, risk_free=s.risk_free, days=s.days))
        if self.store:
            self.store.save_run(run_id, strategy, rule.params(), out.equity, out.fills, out.metrics, {"interval": interval, "capital": s.capital, "commission": s.commission, "slippage": s.slippage})
        return out

    def walk_forward(self, bars: DataFrame, strategy: str, space: dict[str, list]) -> DataFrame:
        s = self.settings
        if walkforward.windows(bars, s.train, s.test, s.step).isEmpty():
            raise WalkForwardError(f"no series has the {s.train + s.test} bars of a window")
        out = walkforward.report(bars, strategy, space, train=s.train, test=s.test, step=s.step, costs=s.costs(), risk_free=s.risk_free, days=s.days)
        if self.store:
            run_id = run_key(bars, {"walk_forward": strategy, "space": space, "settings": asdict(s)})
            self.store.save_walk_forward(run_id, strategy, space, (s.train, s.test, s.step), out)
        return out

    def monte_carlo(self, returns: DataFrame, shocks: list[montecarlo.Shock] = (), method: str = "bootstrap", value: float = 1.0, of_run: str | None = None) -> DataFrame:
        s = self.settings
        if not 100 <= s.n_sims <= 10_000:
            raise SimulationError("from 100 to 10,000 paths")
        history = kept(montecarlo.histories(returns, list(shocks)))
        out = montecarlo.summary(montecarlo.ends(history, s.n_sims, s.horizon, method=method, block=s.block, seed=s.seed, value=value), value)
        if self.store:
            run_id = run_key(returns, {"monte_carlo": method, "shocks": [asdict(x) for x in shocks], "value": value, "settings": asdict(s)})
            self.store.save_monte_carlo(run_id, out, s.horizon, method, of_run)
        return out

    def monte_carlo_of_run(self, run_id: str, symbol: str, **options) -> DataFrame:
        if self.store is None:
            raise ConfigurationError("a store is needed")
        self.store.run(run_id)
        curve = self.store.table("equity_curve").where((F.col("run_id") == run_id) & (F.col("symbol") == symbol))
        return self.monte_carlo(curve.select("ts", "r"), of_run=run_id, **options)

    def risk(self, run_id: str, benchmark: DataFrame | None = None) -> DataFrame:
        if self.store is None:
            raise ConfigurationError("a store is needed")
        self.store.run(run_id)
        curve = self.store.table("equity_curve").where(F.col("run_id") == run_id)
        if curve.where("r is not null").groupBy("symbol").count().where(f"count >= {risk.REPORT_ROWS}").isEmpty():
            raise RiskError(f"{risk.REPORT_ROWS} returns are needed")
        return risk.report(curve.select(F.col("symbol").alias("series_id"), "ts", "r"), benchmark, risk_free=self.settings.risk_free, days=self.settings.days)

    def rolling_risk(self, run_id: str, window: int = 21) -> DataFrame:
        if self.store is None:
            raise ConfigurationError("a store is needed")
        curve = self.store.table("equity_curve").where(F.col("run_id") == run_id)
        made = orderstat.with_risk(curve.select("symbol", "ts", "r"), "r", ["symbol"], ["ts"], window)
        return made.select("symbol", "ts", series.rolling_volatility(F.col("r"), series.ordered(["symbol"], "ts"), window).alias("volatility"), F.col("var").alias("var_95"), F.col("cvar").alias("cvar_95"))

    def compare(self, runs: list[Backtest]) -> DataFrame:
        """Metrics of several runs, one under the other."""
        out = None
        for r in runs:
            rows = r.metrics.select(F.lit(r.run_id).alias("run_id"), "symbol", *metrics.NAMES)
            out = rows if out is None else out.unionByName(rows)
        return out
