"""SPARQL syntax, algebra, cardinality and join order."""
