"""Whole jobs: the report over findings, and a scan of a folder from listing to output."""
