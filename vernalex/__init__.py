"""vernalex - a PySpark-native text-index, record-linkage and search engine."""

__version__ = "0.1.0"
