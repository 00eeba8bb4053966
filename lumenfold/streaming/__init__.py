"""Lumenfold streaming."""
