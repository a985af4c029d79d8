"""Batch operators, grouped by the kind of telemetry they read."""
