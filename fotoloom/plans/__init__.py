"""Fotoloom plans."""
