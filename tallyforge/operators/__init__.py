"""Relational and model operators."""
