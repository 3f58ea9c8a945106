"""SQL statements that state, independently of the Spark code, what each query must return."""
