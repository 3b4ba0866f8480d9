"""quarry: retrieval and corpus analytics on Spark DataFrames."""
