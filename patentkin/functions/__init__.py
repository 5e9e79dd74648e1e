"""Column expressions: one row in, one value out, all evaluated inside the JVM."""
