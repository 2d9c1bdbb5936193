"""Micro-batch versions of batch operators."""
