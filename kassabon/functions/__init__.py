"""Column functions: each takes and returns columns, built on Spark expressions."""
