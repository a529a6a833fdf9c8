"""Column expressions: every function takes and returns a Column, so all of it runs inside the JVM."""
