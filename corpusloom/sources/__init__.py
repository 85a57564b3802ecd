"""Readers, writers, landed JSON, and stage tables."""
