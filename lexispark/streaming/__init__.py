"""Structured Streaming: the intake queue and its states."""
