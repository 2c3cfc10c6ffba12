"""corpuskit: build and query text knowledge corpora with Spark DataFrames."""

__version__ = "0.1.0"
