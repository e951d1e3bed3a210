"""Training-data operators: language ID, dedup, search, audio, mixing, PII, chat, packing.

Nothing outside this subpackage imports it.
"""
