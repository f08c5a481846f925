"""Structured Streaming forms of the history trend and the review state machine."""
