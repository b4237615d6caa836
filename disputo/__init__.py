"""Argument-graph analytics on PySpark: sources, functions, operators, plans and streaming helpers."""
