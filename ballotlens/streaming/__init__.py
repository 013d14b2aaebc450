"""Structured Streaming versions of the sampled-ballot computations (an extra)."""
