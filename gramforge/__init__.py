"""PySpark-native n-gram count analytics, language models and corpus operators."""

__version__ = "0.1.0"
