"""Composed queries: the catalogue of named plans and their SQL."""
