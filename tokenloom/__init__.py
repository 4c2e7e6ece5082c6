"""Search and analytics over annotated text, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
