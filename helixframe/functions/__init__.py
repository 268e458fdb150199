"""Projections of the driver's tables, in Spark and as SQL text."""
