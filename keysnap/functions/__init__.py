"""Column expressions used throughout the library; all of them stay in the JVM."""
