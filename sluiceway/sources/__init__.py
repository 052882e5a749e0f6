"""Readers of captured responses, dimensions and documents."""
