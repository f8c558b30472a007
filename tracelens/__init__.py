"""Spark-native analytics over agent-conversation transcripts."""
