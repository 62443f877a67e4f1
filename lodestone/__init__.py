"""Lodestone: a federated SQL engine that compiles its dialect to Spark DataFrames."""

__all__ = ["__version__"]
__version__ = "0.1.0"
