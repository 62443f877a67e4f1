"""Lexer, syntax tree and parser of the dialect."""
