"""Scalar expressions: cleaning and typing of ledger cells, references, dates, text chunks, similarities."""
