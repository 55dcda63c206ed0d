"""A PySpark-native engine for mining code history, and operators for preparing training text."""

__version__ = "0.1.0"
