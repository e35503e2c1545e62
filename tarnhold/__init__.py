"""Archive listing, audit and extraction as Spark queries."""

__version__ = "0.2.0"
