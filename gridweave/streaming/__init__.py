"""Streaming forms of the grid."""
