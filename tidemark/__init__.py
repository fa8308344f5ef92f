"""Retail analytics and training-data operators as Spark DataFrame queries."""
