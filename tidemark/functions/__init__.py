"""Column-expression helpers (JVM-side) and small pandas UDFs."""
