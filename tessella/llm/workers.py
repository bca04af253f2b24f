"""Python workers that give memory back: the library's."""

from tessella.functions.workers import Batches, frugal, tidy, trim

__all__ = ["Batches", "frugal", "tidy", "trim"]
