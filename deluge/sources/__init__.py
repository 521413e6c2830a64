"""Scans, fixture adapters and sinks."""
