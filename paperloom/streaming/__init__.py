"""Streams of arriving papers: windowed counts with late data, deduplication, store upserts, sessions with a time to live."""
