"""Streaming of the telemetry analytics package."""
