"""Document-corpus analytics as composable Spark DataFrame jobs."""
