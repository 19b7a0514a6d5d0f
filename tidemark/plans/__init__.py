"""Analytics composed of operators, for all entities and periods at once."""
