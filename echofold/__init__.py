"""Duplicate-region analytics and corpus tools on PySpark."""
