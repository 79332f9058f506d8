"""Schemas, and the ledger derived from the test tables."""
