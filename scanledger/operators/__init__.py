"""Filters, cost allocation, roll-ups, top-k."""
