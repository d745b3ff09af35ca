"""Operators of a training-data pipeline: mixing, near-duplicates, quality, tokens, archives, toxicity, decontamination, extraction,
resampling, sharding, fill-in-middle.

Nothing outside this subpackage imports it.
"""
