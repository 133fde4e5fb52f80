"""Errors that the library raises; all derive from TidemarkError."""


class TidemarkError(Exception):
    """Base of all."""


class ConfigurationError(TidemarkError):
    """A setting is missing or out of range."""


class IngestionError(TidemarkError):
    """A source can't be read."""


class DataIntegrityError(IngestionError):
    """Bars break a rule of theirs."""


class StrategyError(TidemarkError):
    """A strategy's parameters are wrong, or it is unknown."""


class BacktestError(TidemarkError):
    """A run can't give a result."""


class InsufficientDataError(BacktestError):
    """A series is shorter than what is asked of it needs."""


class WalkForwardError(TidemarkError):
    """No window fits."""


class SimulationError(TidemarkError):
    """A simulation's history or parameters are out of range."""


class RiskError(TidemarkError):
    """Too few common observations."""


class StoreError(TidemarkError):
    """A stored run is not there."""
