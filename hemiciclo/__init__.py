"""hemiciclo: a Spark-native engine for public parliamentary records."""

__version__ = "0.1.0"
