"""A join with one row for each group that splits hot groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups with this share of all rows are joined by a broadcast, which holds 1 / HOT_SHARE rows at most.
HOT_SHARE = 1 / 2000


def group_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` inner joined with one row for each group; ``size`` is a group's number of rows and ``total`` that of all.

    Groups of ``HOT_SHARE`` of all rows are 2,000 at most and are broadcast; the others are shuffled, and none of them is
    large, so no task gets a hot group whole. Keys must not be null.
    """
    hot = F.broadcast(groups.filter(F.col(size) >= total * HOT_SHARE))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(groups.filter(F.col(size) < total * HOT_SHARE), keys)
    return rows.join(hot, keys).unionByName(cold)
