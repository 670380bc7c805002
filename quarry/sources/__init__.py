"""Readers and writers of file, blob, config and finding tables."""
