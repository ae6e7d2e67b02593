"""spanmill: text-corpus preparation as plain Spark DataFrame jobs."""
