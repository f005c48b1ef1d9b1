"""Structured Streaming jobs over request streams."""
