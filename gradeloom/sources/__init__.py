"""Readers, writers and table updates."""
