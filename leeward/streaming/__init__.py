"""Structured Streaming forms of the sensor path, the registry and device health."""
