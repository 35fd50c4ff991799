"""Registered queries, by topic."""
