"""Comparison, gating, expansion, ordering and data-side operators."""
