"""fathom: a Spark-native multi-stage text retrieval engine."""

__version__ = "0.1.0"
