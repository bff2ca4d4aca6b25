"""Operators of the session-evidence model."""
