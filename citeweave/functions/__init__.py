"""Subpackage of citeweave."""
