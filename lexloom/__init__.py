"""lexloom: text-corpus analytics as Spark DataFrame, SQL and Structured Streaming operations."""
