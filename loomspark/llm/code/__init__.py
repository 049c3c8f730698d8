"""Lexers, bracket trees, grammars and the error-correcting parser for source files."""
