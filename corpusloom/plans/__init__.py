"""Helpers that shape plans: lineage cuts, distributed ranks, top-k."""
