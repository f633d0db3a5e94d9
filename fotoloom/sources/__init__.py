"""Fotoloom sources."""
