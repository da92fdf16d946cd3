"""Scans, declared sources, catalog access and test-data adapters."""
