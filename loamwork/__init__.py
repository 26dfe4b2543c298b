"""loamwork: a PySpark-native engine that turns raw documents into clean, searchable knowledge."""

__version__ = "0.1.0"
