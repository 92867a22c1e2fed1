"""Readers and writers of edge, entity and interaction data."""
