"""Results by content: what was recognised before is not recognised again."""

from __future__ import annotations

from pyspark.sql import DataFrame


def hits(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return requests.join(cache, key)


def misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Each missing key once: the rows to send to a recogniser, filtered before it, for a condition around a Python function doesn't guard it."""
    return requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])
