"""tidewright: specification-driven data pipelines as plain Spark DataFrame jobs."""
