"""Structured Streaming: daily delivery and late rows against a watermark."""
