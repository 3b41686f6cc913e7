"""Files and tables as input: listing, reading, and text extraction."""
