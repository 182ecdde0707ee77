"""Annotation tables, the commands built on them, and the registered queries."""
