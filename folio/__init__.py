"""Folio: scanned-document analytics on Spark DataFrames."""
