"""Operators for preparing training text: duplicates, quality, leaks, packing and sharding."""
