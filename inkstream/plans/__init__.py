"""Topic queries and composed reads."""
