"""Snapshots, logs and tables at rest."""
