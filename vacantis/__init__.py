"""Job-posting analytics as Spark DataFrame jobs."""
