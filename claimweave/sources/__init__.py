"""Readers, sinks and the views derived from the driver tables."""
