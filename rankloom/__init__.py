"""Rankloom: retrieval, ranking and evaluation operators as PySpark DataFrame transformations."""
