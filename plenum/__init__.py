"""Parliamentary analytics as Spark DataFrame jobs."""
