"""Subpackage of threadlake."""
