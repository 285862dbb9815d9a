"""Shaping of raw inputs into the panel tables, and dated snapshots of those tables."""
