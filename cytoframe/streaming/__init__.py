"""Streaming of the sequencing analytics engine."""
