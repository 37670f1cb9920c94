"""Streaming wrappers around batch operators."""
