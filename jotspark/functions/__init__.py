"""Column functions by category; every function takes and returns Spark columns."""
