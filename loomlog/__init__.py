"""Schema-merging log analytics as PySpark DataFrame jobs."""
