"""tagweave: symbol-and-tag analytics as Spark DataFrame jobs."""
