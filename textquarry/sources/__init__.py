"""Readers of files and writers of results."""
