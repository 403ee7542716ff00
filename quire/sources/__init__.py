"""Scans and parsers: table dumps, page-view files, visit tables, page graphs."""
