"""Operators for preparing training corpora; nothing outside this package imports it."""
