"""Subpackage of pairloom."""
