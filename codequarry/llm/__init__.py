"""Training-data operators: mixing, deduplication, filtering, scanning and scoring of documents.

Nothing outside this subpackage imports it.
"""
