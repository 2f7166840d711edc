"""Column -> Column helpers; everything stays in JVM built-ins."""
