"""Readers and writers for catalogues, dictionaries, query logs and curves."""
