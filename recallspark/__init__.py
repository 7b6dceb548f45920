"""A Spark-first engine for conversational memory and retrieval."""
