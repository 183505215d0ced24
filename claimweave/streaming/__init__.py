"""Structured Streaming forms of the stages whose input arrives over time."""
