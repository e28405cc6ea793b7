"""Entrywise: file-system metadata analytics on PySpark."""
