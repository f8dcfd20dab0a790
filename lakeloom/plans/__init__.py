"""Compositions: evaluation, telemetry, search and answering."""
