"""Property-graph queries compiled to Spark DataFrames."""
