"""landweave: a Spark-native engine that reconciles spatial land records."""

__version__ = "0.1.0"
