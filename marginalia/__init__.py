"""marginalia: a Spark-native engine for tabular synthesis, prompt data and evaluation of synthetic text."""

__version__ = "0.1.0"
