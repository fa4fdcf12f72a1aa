"""Change-log merge engine and corpus operators on plain PySpark."""

__version__ = "0.1.0"
