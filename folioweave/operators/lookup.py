"""Exact lookups of counts that are too many to broadcast, by keys of which a few may be on every row.

Keys that make up at least RATE of all asked, of which there can't be more than 1 / RATE, meet their counts by a broadcast;
the rest by a shuffle in which no key is that frequent. Nothing is cut off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.session import cut

RATE = 1e-3


def looked_up(asked: DataFrame, counts: DataFrame, key: str, rate: float = RATE) -> DataFrame:
    """asked (key, ...) with the columns of counts (key, ...), inner; null keys find nothing; counts may have several rows a key."""
    held = cut(asked.where(F.col(key).isNotNull()))
    by = cut(held.groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    floor = (by.agg(F.sum("_n")).first()[0] or 0) * rate
    hot = F.broadcast(by.where(F.col("_n") >= max(floor, 2)).select(key))  # at most 1 / rate keys
    often = held.join(hot, key, "left_semi").join(F.broadcast(counts.join(hot, key, "left_semi")), key)
    return often.unionByName(held.join(hot, key, "left_anti").join(counts, key))
