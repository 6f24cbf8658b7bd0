"""Compressive (sketched) learning on Spark."""
