"""Part of the ingestion engine."""
