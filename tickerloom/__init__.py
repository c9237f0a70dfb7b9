"""tickerloom: equity screening and follow-up as Spark DataFrame jobs."""

__version__ = "0.1.0"
