"""Readers and writers for run tables, telemetry, logs and reports."""
