"""Scans of files, and the set of sources that a union is made of."""
