"""Queries over the test tables, and the views that shape those tables."""
