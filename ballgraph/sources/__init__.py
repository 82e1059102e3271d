"""Scans, sinks and input checks."""
