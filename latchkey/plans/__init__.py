"""Registered queries, composed from operators, and their SQL."""
