"""Readers, writers and the fixture relations."""
