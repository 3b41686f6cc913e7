"""Detectors as data, the registry that selects them, and the scan that runs them."""
