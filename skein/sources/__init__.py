"""Text readers and writers, and the versioned graph store."""
