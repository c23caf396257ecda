"""Readers and writers of telemetry."""
