"""Lumenfold functions."""
