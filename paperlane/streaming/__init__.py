"""Intake of files as they arrive."""
