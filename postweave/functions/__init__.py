"""Column expressions; all are built from JVM-side functions."""
