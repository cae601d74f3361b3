"""Content-addressed blob catalogue and cache-policy engine on Spark."""

__version__ = "0.1.0"
