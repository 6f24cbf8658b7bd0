"""Sketches of streams."""
