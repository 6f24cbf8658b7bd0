"""Sketches and what is learned from them."""
