"""Constraint scoring, reports and training-data jobs as Spark DataFrame programs."""
