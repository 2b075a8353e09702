"""Relational operators: revisions, ordered reads, identity, odds, quality."""
