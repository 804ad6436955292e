"""Scoring of files as they arrive."""
