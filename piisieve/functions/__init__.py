"""Column functions: patterns, matches with offsets, checksums, scores."""
