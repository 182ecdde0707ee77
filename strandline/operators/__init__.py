"""Relational operators on annotations and regions."""
