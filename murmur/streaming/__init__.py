"""Structured Streaming: alerts, windows, sinks."""
