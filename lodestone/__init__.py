"""Lodestone: repository-intelligence analytics and data operators on PySpark."""
