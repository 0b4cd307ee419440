"""Asset search and scene-graph analytics on Spark DataFrames."""
