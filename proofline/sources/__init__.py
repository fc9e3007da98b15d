"""Scans, dimension tables, derived inputs and sinks."""
