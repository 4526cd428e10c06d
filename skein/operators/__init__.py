"""Graph operators: reads, ranges, partitions, updates and whole-graph kernels."""
