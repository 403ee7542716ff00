"""The same parsers over files that keep arriving."""
