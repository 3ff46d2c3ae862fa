"""Readers, catalog access and sinks."""
