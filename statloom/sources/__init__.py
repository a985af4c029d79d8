"""Readers and writers of exported telemetry."""
