"""Readers: project listings, ignore rules, caches, front matter, configuration and git."""
