"""Fotoloom functions."""
