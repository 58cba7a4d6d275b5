"""Readers that produce the canonical marketplace tables."""
