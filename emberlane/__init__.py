"""Emberlane: building-energy and training-data analytics as Spark DataFrame jobs."""
