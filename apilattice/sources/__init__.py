"""Readers of API indexes, source trees, build files and messages, and writers of results."""
