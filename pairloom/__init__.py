"""Document-similarity analytics expressed as Spark DataFrame jobs."""
