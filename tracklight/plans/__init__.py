"""Ordered lists and the pipelines compiled to them."""
