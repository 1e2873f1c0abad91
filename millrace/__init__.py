"""Governed ingestion and corpus preparation on Spark."""
