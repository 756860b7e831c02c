"""Readers of images, labels and settings."""
