"""Readers, column detection, normalisation and test views."""
