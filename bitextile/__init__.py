"""bitextile: Spark-native analysis and alignment of parallel text corpora."""

__version__ = "0.1.0"
