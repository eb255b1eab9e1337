"""Operators for preparing training text: filters, duplicates, extraction, tokens, packing and vector search."""
