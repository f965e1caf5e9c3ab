"""Code-graph, ranking and context-selection engine on Spark DataFrames."""
