"""Readers and writers of transcript files, and the two transcript grammars."""
