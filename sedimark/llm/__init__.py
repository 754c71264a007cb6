"""Operators for training text: syntax, provenance, formatting duplicates, credentials, tokens, packing and reading level."""
