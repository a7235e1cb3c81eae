"""Column functions: text, JSON and vector expressions built from Spark built-ins."""
