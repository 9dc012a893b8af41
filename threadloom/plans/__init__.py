"""Helpers that shape plans: cutting lineage, skew-proof joins, bounded broadcasts."""

from .shape import bounded_broadcast, cut, hot_keys, hot_of, shared_folder, skew_join

__all__ = ["bounded_broadcast", "cut", "hot_keys", "hot_of", "shared_folder", "skew_join"]
