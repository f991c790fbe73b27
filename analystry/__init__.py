"""Exploratory and scorecard analytics as Spark DataFrame jobs."""
