"""Registered queries over the standard tables, with their oracle SQL."""
