"""Search-corpus analytics as Spark DataFrame jobs."""
