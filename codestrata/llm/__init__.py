"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it (it uses only ``codestrata.ship``), and it can be
deleted without touching the source-structure engine.
"""
