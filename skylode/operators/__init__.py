"""Relational, graph and matching operators."""
