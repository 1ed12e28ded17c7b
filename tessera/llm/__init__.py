"""Operators for preparing training corpora.

Nothing else in :mod:`tessera` imports this subpackage.
"""
