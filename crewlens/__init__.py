"""Hiring analytics as Spark DataFrame transformations."""
