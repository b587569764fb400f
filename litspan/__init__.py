"""litspan: scientific-literature search, ingestion and retrieval on Spark DataFrames."""
