"""Streaming jobs and user-function contracts."""
