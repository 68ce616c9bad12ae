"""Telemetry as a stream."""
