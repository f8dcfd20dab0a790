"""Readers and validation."""
