"""Column-level functions (Spark built-ins, one Arrow UDF)."""
