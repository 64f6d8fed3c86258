"""Technical indicators. Importing this package fills the registry."""

from tickloom.operators.indicators import (
    momentum,
    pattern,
    statistical,
    strength,
    trend,
    volatility,
    volume,
)

__all__ = ["momentum", "pattern", "statistical", "strength", "trend", "volatility", "volume"]
