"""Readers: job logs, project settings, stored snapshots, table metadata."""
