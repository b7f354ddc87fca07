"""Search and state over files and rows that arrive."""
