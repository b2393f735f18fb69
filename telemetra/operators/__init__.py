"""Operators of the telemetry analytics package."""
