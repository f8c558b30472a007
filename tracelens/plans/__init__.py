"""Whole dataflows: reduction, diagnosis, browsing, and the driver tables as transcripts."""
