"""Readers, writers and the star schema over the test tables."""
