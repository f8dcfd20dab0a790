"""Text retrieval and evidence analytics on Spark DataFrames."""
