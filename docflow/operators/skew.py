"""Joins back from groups to their rows that stand a hot group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with over one row in HOT of all rows is hot; there are fewer than HOT such groups.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, ask: bool = False) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row per key and its ``size``.

    Hot groups (``size`` over ``total`` / HOT, so fewer than HOT of them) are broadcast, and their
    rows are not shuffled. The others are joined by a shuffle on the key, where no key holds
    more than one row in HOT. Rows without a group are dropped; so are null keys. With ``ask``
    (for staged groups and wide rows) a job asks first whether there are other groups at all.
    """
    others = [c for c in groups.columns if c != key]
    hot = F.col(size) * HOT > total
    few = groups.filter(hot).select(key, F.struct(*others).alias("_group"))
    marked = rows.join(F.broadcast(few), key, "left")
    own = rows.columns
    quick = marked.filter(F.col("_group").isNotNull()).select(*own, "_group.*")
    cold = groups.filter(~hot)
    if ask and cold.isEmpty():
        return quick.select(*own, *others)
    slow = marked.filter(F.col("_group").isNull()).select(*own).join(cold, key)
    return quick.unionByName(slow.select(*own, *others))
