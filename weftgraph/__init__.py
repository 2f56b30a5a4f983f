"""Graph analytics over DataFrames: a graph is a table of nodes and a table of edges."""
