"""Sources and sinks: ledger frames, sheets, documents, dictionaries, caches, result bundles."""
