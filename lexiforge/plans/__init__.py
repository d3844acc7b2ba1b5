"""Query parsing and the query registry."""
