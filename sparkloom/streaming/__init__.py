"""Structured Streaming: a source that tails growing logs, and keyed state over what it brings."""
