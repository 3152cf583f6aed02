"""Lumenbase: knowledge-base analytics on PySpark."""
