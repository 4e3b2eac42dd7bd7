"""Operators of a training-data pipeline: tokens, near copies, quality, secrets, shards, pages."""
