"""tessella: build, validate and audit typed knowledge graphs with PySpark."""

__all__ = ["session", "vocab"]
