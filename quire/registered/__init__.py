"""Registered queries: each applies operators to whole tables, with SQL that states the same rows."""
