"""Retail demand signals on Spark: zero-sale run tests and promotion effects."""

from shelfwatch.params import Params

__all__ = ["Params"]
