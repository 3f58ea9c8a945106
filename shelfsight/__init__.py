"""Shelfsight: product-catalog imagery analytics on PySpark."""

__version__ = "0.1.0"
