"""Plan-level helpers: lineage cuts, size-checked joins, bounded loops."""
