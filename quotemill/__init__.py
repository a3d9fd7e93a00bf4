"""Price-bar analytics as Spark jobs: bars, indicators, rules, positions, metrics, sweeps."""

from quotemill.params import Params

__all__ = ["Params"]
