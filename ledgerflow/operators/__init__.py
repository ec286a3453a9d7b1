"""Relational operators on ledger frames: labels, row assembly, candidate edges, staged matching, folds, page layout."""
