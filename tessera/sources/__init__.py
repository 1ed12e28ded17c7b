"""Readers and writers, and literal example tables."""
