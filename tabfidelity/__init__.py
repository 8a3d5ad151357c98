"""Judging synthetic tables against real ones with PySpark."""
