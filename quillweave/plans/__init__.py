"""Whole plans: from pages to a searchable index."""
