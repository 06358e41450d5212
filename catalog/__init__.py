"""Registered queries over the given tables and their independent SQL statements."""

from catalog.registry import ORACLES, QUERIES  # noqa: F401
from catalog import bars, features, files, forecasts, learning, linear, rules, screens, streams  # noqa: F401
