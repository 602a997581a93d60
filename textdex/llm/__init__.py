"""Operators for preparing training text: counts, heavy hitters, repair, scoring, encoding, leaks, look-alikes.

Nothing outside this subpackage imports it.
"""
