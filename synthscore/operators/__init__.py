"""Relational operators, one module per inventory group."""
