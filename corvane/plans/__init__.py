"""Registered queries and multi-step jobs."""
