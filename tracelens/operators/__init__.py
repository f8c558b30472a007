"""Operators over records, blocks and verb events."""
