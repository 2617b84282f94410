"""Relational operators of the ledger; each takes and gives DataFrames."""
