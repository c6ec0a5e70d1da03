"""Structured Streaming forms of the lifecycle rules and running reports."""
