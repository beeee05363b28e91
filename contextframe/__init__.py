"""contextframe: a PySpark-native analytics engine for code, log, event and memory data."""

__version__ = "0.1.0"
