"""geolode: a Spark-native relational and geospatial query engine."""

__version__ = "0.1.0"
