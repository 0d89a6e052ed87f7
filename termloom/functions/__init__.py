"""Column functions (JVM side) and Arrow-batched scalar functions."""
