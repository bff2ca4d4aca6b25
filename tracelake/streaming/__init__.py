"""Streaming of the session-evidence model."""
