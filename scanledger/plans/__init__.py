"""The user-day mart, the summaries built on it, reports and monitoring runs."""
