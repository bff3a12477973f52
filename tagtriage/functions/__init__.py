"""Column builders: pure ``Column -> Column`` functions, JVM-side, no UDFs."""
