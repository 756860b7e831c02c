"""Operators for preparing large text and media corpora for model training.

Nothing else in the library imports this subpackage.
"""
