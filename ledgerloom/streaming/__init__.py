"""Structured Streaming forms of the mempool and block operators."""
