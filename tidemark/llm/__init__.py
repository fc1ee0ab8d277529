"""Operators of a training-data pipeline: deduplication, tokenising, packing, scoring and filtering.

Nothing outside this subpackage imports it."""
