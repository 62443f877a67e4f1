"""Relational operators that a DataFrame method doesn't express alone."""
