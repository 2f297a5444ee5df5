"""Column functions: every one takes and returns a ``Column`` and runs inside the JVM."""
