"""Regional demand-signal analytics as Spark DataFrame jobs."""
