"""Quantification of regions that arrive in a stream."""
