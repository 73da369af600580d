"""Symbol-sequence analytics and corpus preparation as plain Spark jobs."""
