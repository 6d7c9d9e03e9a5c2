"""Core sources."""
