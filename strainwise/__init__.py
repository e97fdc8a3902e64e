"""Workforce wellbeing analytics as PySpark DataFrame transformations."""
