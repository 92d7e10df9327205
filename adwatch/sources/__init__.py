"""Readers, writers and seed tables."""
