"""Retrieval analytics and corpus preparation as Spark DataFrame and SQL plans."""
