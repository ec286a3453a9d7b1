"""Structured Streaming entry points for ledger drops."""
