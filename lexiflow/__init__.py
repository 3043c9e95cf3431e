"""Corpus preparation and evaluation analytics as Spark query plans."""
