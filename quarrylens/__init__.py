"""Quarrylens: code-knowledge analytics and corpus preparation on PySpark."""
