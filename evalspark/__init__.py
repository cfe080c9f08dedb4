"""Evaluation analytics over stored runs, as DataFrame and SQL expressions."""
