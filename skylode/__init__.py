"""Skylode: dataset audits, detection scoring and corpus preparation as Spark plans."""
