"""Column functions. All are built from native Spark expressions."""
