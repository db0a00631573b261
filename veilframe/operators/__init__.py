"""Operators on frames: cleaning, encoding, statistics, privacy, synthesis, learning."""
