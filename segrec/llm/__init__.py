"""Operators for preparing training text: de-duplication, packing, filtering, extraction and mixing."""
