"""Elevation-aware relational and graph operators."""
