"""Functions of the telemetry analytics package."""
