"""Fotoloom streaming."""
