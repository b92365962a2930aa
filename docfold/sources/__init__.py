"""Readers of files into lines, blocks and records."""
