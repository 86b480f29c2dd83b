"""Fraud-correlation and risk analytics as Spark jobs."""
