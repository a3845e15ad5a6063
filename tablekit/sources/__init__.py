"""Reading, writing and normalising tables."""
