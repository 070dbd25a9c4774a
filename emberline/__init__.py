"""emberline: a Spark-native feature engine for station weather, gridded geography and fire records."""

__version__ = "0.1.0"
