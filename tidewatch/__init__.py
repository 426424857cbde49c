"""Telemetry anomaly analytics as Spark DataFrame operators."""
