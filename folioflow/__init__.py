"""Document-to-narration analytics on Spark DataFrames."""
