"""Operators on entry tables: one row per runner per race."""
