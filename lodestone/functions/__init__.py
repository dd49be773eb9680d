"""Column functions: vectors, text and geometry. All stay in the JVM."""
