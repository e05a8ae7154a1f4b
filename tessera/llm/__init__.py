"""Operators for training-data pipelines: filtering, dedup, mixing, sharding, packing, archives."""
