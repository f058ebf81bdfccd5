"""Column expressions: exact decimals, canonical text, digests."""
