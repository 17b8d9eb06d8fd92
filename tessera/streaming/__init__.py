"""Event-time operators that run alike on batch and streaming DataFrames."""
