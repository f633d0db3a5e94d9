"""Fotoloom operators."""
