"""Telemetry anomaly and drift analytics expressed as Spark jobs."""
