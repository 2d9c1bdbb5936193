"""Readers, writers and the tables that are derived from them."""
