"""Readers, writers and the dataset handle."""
