"""tapewright: a PySpark-native analytics engine for recording catalogs."""

__version__ = "0.1.0"
