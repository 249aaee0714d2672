"""Readers for feed archives, catalogue files and earlier outputs."""
