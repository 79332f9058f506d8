"""A ledgered incremental-ingestion engine on Spark."""
