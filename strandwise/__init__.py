"""strandwise: a PySpark-native engine for positioned, stranded and grouped records."""

__version__ = "0.1.0"
