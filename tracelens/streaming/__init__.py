"""Appended transcripts as streams."""
