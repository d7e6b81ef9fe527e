"""Corpus and event analytics as Spark DataFrame operators."""
