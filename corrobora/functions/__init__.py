"""Column functions: text, sets and statistics. All are built-in expressions, evaluated in the JVM."""
