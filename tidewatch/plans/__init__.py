"""Gating, end-to-end plans, and the query catalog."""
