"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from wavemill.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
