"""doctables: clean relational datasets from document tables, as Spark jobs."""

__version__ = "0.1.0"
