"""Whole queries: operators bound to tables."""
