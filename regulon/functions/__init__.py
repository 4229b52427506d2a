"""Column-level building blocks (native Spark expressions, no Python UDFs)."""
