"""Column functions: JVM-side expressions, no Python in the row path."""
