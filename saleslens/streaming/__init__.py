"""Structured Streaming: the panel's totals and streaks over arriving sales."""
