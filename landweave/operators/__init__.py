"""Relational, spatial and graph operators as DataFrame transformations."""
