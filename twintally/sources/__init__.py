"""Listings, delimited files, archives and staged tables."""
