"""Operators for preparing training text: filters, duplicates, models, formatting and packing."""
