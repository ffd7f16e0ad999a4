"""Streams of documents and events."""
