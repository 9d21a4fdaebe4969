"""Structured Streaming counterparts of the stateful operators."""
