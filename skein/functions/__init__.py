"""Functions that make or reshape graphs."""
