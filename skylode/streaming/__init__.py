"""Structured Streaming forms: ledgers verified as they grow, windowed event metrics.

The batch operators read whole tables; these keep up with appended files.
"""
