"""Streaming sequence-graph analytics on Spark."""
