"""Query parsing and the catalogue of queries with their SQL equivalents."""
