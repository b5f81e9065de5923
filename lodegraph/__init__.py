"""lodegraph: SPARQL over RDF graphs, planned in Python and run as Spark DataFrames."""
