"""tidemark: bar-data analytics, back-testing and risk as Spark DataFrame operations."""
