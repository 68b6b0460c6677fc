"""Retrieval analytics and corpus preparation on PySpark."""
