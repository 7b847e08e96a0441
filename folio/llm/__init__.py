"""Training-data operators over the exported texts of scanned documents.

Nothing outside this package imports it.
"""
