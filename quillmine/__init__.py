"""Analytics for software-engineering data, declared as Spark plans."""

__version__ = "0.1.0"
