"""Whole plans, from files to records."""
