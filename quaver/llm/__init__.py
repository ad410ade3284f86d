"""Operators for training-data pipelines: splits, overlaps, canonical values, near-duplicates,
samples, packing, leakage and consistent text forms.

Nothing outside this package imports it.
"""
