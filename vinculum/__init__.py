"""vinculum: a PySpark engine for knowledge graphs built from document collections."""

__version__ = "0.1.0"
