"""Incremental use: files that arrive as a stream, merged into stored tables."""
