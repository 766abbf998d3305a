"""Structured Streaming: bars from an event stream."""
