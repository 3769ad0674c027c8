"""Statement analytics and corpus preparation as Spark DataFrame operations."""
