"""Readers, writers and saved models."""
