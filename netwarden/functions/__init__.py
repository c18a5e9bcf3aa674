"""Column-level functions (scalar expressions, no UDFs)."""
