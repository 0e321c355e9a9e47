"""Training-data operators: scoring, mixing, deduplication, extraction, packing and output.

Nothing outside this folder imports it; it can be removed as a whole.
"""
