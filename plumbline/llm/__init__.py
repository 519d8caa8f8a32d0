"""Operators for preparing training data: scoring, packing, filtering, scanning, mixing, fingerprints, deduplication."""
