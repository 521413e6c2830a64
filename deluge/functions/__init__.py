"""Column-level helpers (JVM-side expressions; geometry parsing adds staged columns)."""
