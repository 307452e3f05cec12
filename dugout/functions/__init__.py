"""Column builders: every function takes and returns Columns, all evaluated in the JVM."""
