"""Column expressions shared by the operators; all run inside the JVM unless a name ends in ``_udf``."""
