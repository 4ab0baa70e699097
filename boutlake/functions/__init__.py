"""Subpackage of boutlake."""
