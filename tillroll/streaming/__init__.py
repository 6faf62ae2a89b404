"""Structured Streaming drivers for the batch operators."""
