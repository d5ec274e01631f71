"""Structured Streaming: continuous intake and running trends."""
