"""Structured Streaming twins of the keyed-state operators, and routes for event streams."""
