"""Reading SPARQL SELECT queries."""
