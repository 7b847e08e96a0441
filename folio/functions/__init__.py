"""Columns from columns: labels, geometry, text layout, colours."""
