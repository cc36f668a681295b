"""Sales performance and message quality as PySpark DataFrame and Structured Streaming jobs."""
