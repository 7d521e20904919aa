"""Streaming forms of the stateless operators, and deduplication within a watermark."""
