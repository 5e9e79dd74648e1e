"""Readers, writers and the sample views over the test tables."""
