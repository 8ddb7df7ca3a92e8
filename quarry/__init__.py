"""quarry: text, vector, graph and event analytics on Spark DataFrames."""
