"""Streams of records: merges without state, and running counters with it."""
