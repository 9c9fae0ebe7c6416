"""A property-graph engine on Spark DataFrames."""
