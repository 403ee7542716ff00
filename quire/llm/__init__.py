"""Operators for preparing large text corpora. Nothing else in quire imports this subpackage."""
