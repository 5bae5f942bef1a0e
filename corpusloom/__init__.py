"""Analytics of embedding corpora on Spark DataFrames."""

__version__ = "0.2.0"
