"""Folders read as streams (beyond what batch queries need)."""
