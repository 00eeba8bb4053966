"""Lumenfold operators."""
