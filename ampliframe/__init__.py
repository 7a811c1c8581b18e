"""Amplicon (marker-gene) analytics as Spark DataFrame jobs."""
