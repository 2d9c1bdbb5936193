"""Column functions and the constants of the retrieval policy."""
