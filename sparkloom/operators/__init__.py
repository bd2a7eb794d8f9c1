"""Relational operators, each with the SQL that states its result."""
