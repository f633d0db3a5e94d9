"""Fotoloom: a Spark-first engine for cataloguing, scoring, tagging and curating photo collections."""
