"""sparktab: compact, self-describing columnar documents and their analytics on Spark."""

__version__ = "0.1.0"
