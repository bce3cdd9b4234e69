"""Operators of a training-data pipeline: mixing, sharding, deduplication,
secret scanning, page extraction, packing, search and toxicity scoring."""
