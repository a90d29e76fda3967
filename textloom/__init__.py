"""A PySpark-native engine for building and assessing labeled text datasets."""

__version__ = "0.1.0"
