"""Claim-set analytics on Spark: DataFrame-first operators over an append-only record."""
