"""Operators for preparing training corpora at scale.

Nothing outside this folder imports it; ``queries.py`` lists the registered queries.
"""
