"""logweir: log search, analytics and text-corpus processing, declared as Spark plans."""

__version__ = "0.1.0"
