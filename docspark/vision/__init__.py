"""Pixel operators in numpy, run over batches of images by Arrow."""
