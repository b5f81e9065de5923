"""The algebra of graph patterns and its lowering to DataFrames."""
