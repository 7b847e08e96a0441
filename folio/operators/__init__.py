"""Operators on tables of pages, words, images and rasters."""
