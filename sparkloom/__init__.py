"""Source-repository and text analytics as Spark DataFrame operations."""
