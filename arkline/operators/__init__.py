"""Relational operators over files, formats, entries, plans, evidence and catalogs."""
