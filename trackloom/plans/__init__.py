"""Queries: operators applied to the bridge views."""
