"""Sources of the session-evidence model."""
