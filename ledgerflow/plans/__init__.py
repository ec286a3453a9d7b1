"""Composed plans: reconciliation, summaries, review queues, quality reports, structural comparison."""
