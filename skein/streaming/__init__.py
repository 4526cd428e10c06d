"""Streams of edges."""
