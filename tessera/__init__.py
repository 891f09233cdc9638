"""Property-graph analytics and data-pipeline operators on Spark DataFrames."""
