"""quaver: a Spark-native engine for building and scoring benchmarks over corpora of textual music."""

__version__ = "0.1.0"
