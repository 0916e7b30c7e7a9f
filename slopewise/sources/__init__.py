"""Readers, writers and the derived street network."""
