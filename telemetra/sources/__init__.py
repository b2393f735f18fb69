"""Sources of the telemetry analytics package."""
