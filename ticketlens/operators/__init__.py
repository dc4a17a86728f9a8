"""Reusable distributed operators (ordered prefixes, percentiles, open-at-T, ranking)."""
