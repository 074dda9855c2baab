"""Temporal graph geometry and corpus operators on Spark."""
