"""Readers of files and feeds."""
