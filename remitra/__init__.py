"""Cross-border transfer analytics as Spark DataFrame jobs."""
