"""Relational operators of the finance engine, each a DataFrame -> DataFrame function."""
