"""Readers of delimited text, lines, workbooks and page fragments, and what selects and identifies their files."""
