"""Readers that turn files and response bodies into relations, and table sinks."""
