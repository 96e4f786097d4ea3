"""jotspark: JSON-style analytics expressed as Spark DataFrame operations."""
