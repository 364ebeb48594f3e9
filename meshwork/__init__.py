"""meshwork: a graph-mining engine on Spark DataFrames."""
