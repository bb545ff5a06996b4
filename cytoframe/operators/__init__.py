"""Operators of the sequencing analytics engine."""
