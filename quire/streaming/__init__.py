"""Append logs as streams."""
