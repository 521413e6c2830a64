"""User-level jobs composed from operators, and the query registry."""
