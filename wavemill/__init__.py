"""Spark-native engine for labelled, leak-safe signal datasets."""

from wavemill.session import get_session

__all__ = ["get_session"]
__version__ = "0.1.0"
