"""The same scan over files as they arrive."""
