"""Typed tables and what is computed over them."""
