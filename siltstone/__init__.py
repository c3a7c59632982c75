"""siltstone: a Spark-first knowledge retrieval and corpus analytics engine."""

__version__ = "0.1.0"
