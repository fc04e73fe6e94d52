"""Log scans, one extractor per log family, the ledger table and price profiles."""
