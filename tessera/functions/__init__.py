"""Scalar functions as Spark columns, with NumPy twins."""
