"""Structured Streaming front ends of the plans."""
