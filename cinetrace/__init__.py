"""Timeline analytics over recordings, as Spark DataFrame jobs."""
