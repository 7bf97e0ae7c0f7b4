"""Bounded reads as streams of batches, and windowed aggregation of event streams."""
