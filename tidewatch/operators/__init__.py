"""Scoring operators: each takes canonical events, returns (entity_id, score)."""
