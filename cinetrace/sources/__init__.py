"""Readers, writers and keyed writes."""
