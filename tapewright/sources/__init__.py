"""Readers: JSON lines, file listings, guide sidecars, rule files."""
