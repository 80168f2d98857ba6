"""Hierarchical smart-meter load analytics on Spark."""

from meterload.config import FEATURES, GENERATORS, LEVELS, SENSORS, Config

__all__ = ["Config", "FEATURES", "GENERATORS", "LEVELS", "SENSORS"]
