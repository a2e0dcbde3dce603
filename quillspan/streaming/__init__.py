"""Streams of files and events."""
