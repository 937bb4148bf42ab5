"""Document-ingestion analytics as Spark DataFrame jobs."""
