"""Incremental index maintenance and windowed telemetry."""
