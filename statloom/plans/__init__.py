"""Reusable plan shapes: preceding-snapshot pairing, ranking per group, totals joined back."""
