"""Operators that prepare text corpora for model training.

Nothing outside this subpackage imports it, except the guarded entry point and
``corpus_pipeline``.
"""
