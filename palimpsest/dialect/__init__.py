"""Lexer and parser of the SQL dialect."""
