"""Analytics over ordered numeric series, declared as Spark plans."""

__version__ = "0.1.0"
