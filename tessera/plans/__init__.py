"""Composed plans: hybrid retrieval and incremental ingestion."""
