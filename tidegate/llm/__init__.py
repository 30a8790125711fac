"""Operators of a training-data pipeline: filters, extraction, deduplication, packing. Nothing else imports them."""
