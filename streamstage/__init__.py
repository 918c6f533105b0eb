"""streamstage: a PySpark-native stream-analytics engine."""

__version__ = "0.1.0"
