"""Hierarchical text-memory analytics, expressed as DataFrame plans."""
