"""Registered queries and the evaluation pipeline."""
