"""Structured Streaming forms of the ledger and of keyed adaptive state."""
