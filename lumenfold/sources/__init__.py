"""Lumenfold sources."""
