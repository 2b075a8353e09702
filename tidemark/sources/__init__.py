"""Readers and writers for provider files, the payload archive and the fact tables."""
