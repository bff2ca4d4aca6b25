"""Functions of the session-evidence model."""
