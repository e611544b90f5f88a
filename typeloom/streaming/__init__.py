"""Profiles of streams, kept up by mergeable aggregates."""
