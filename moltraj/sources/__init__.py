"""Reading and writing landed tables."""
