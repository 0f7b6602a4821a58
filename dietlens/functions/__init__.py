"""Column-to-column functions. Every one is built from Spark SQL expressions."""
