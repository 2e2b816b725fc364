"""ravelin: retrieval, vector search and private-lookup analytics on Spark DataFrames."""

__version__ = "0.1.0"
