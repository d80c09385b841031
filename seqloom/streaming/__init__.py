"""Structured Streaming: hits as they come, state by read, decisions, reports and versioned tables."""
