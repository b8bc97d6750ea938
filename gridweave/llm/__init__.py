"""Operators for text corpora. Nothing outside this subpackage imports it."""
