"""Places of rows in an order, over tables of any size: sorted ranges and the running sum of their sizes, never all rows in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: monotonically_increasing_id has the partition above this many bits, and the place in it below.
IN_PART = 33


def _names(rows: DataFrame, *wanted: str) -> list[str]:
    """Column names that rows doesn't have, compared without case."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def positions(rows: DataFrame, order: list[Column], put: Callable[[DataFrame], DataFrame], name: str = "position") -> DataFrame:
    """rows with `name`, their place from 0 in `order` over the whole table, as a long.

    Two passes: rows are range-partitioned and sorted, which `put` writes to a table and reads again, so that places don't depend on a
    retry; then each range gets the number of rows in the ranges before it, of which there are no more than shuffle partitions. Rows that are
    equal in `order` have places in no fixed order among themselves, and are spread over ranges however many they are.
    """
    salt, at, part, first, before = _names(rows, "salt", "at", "part", "first", "before")
    salted = rows.withColumn(salt, F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*order, F.col(salt)).sortWithinPartitions(*order, F.col(salt)).drop(salt)
    placed = put(ranged.withColumn(at, F.monotonically_increasing_id()))
    mask = (1 << IN_PART) - 1
    sizes = placed.groupBy(F.shiftright(at, IN_PART).alias(part)).agg(F.count(F.lit(1)).alias(first))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(first).over(earlier), F.lit(0)).alias(before))
    joined = placed.join(starts, F.shiftright(placed[at], IN_PART) == starts[part])
    return joined.select(*(placed[c] for c in rows.columns), (F.col(before) + F.col(at).bitwiseAND(F.lit(mask))).alias(name))


def positions_within(rows: DataFrame, groups: list[str], order: list[Column], put: Callable[[DataFrame], DataFrame], name: str = "position") -> DataFrame:
    """rows with `name`, their place from 0 in `order` among the rows of their group, which may hold any share of all rows.

    Places over the whole table, less the place at which the group begins. Group keys may be null; a null is a group of its own. Where each
    group begins is a row for each group and small beside the rows; Spark splits a hot group's rows where it joins them by a shuffle.
    """
    overall, = _names(rows, "overall")
    placed = positions(rows, [*(F.col(g) for g in groups), *order], put, overall)
    begins, *keys = _names(placed, "begins", *(f"key_{k}" for k in range(len(groups))))
    starts = placed.groupBy(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True))).agg(F.min(overall).alias(begins))
    same = [placed[g].eqNullSafe(starts[k]) for g, k in zip(groups, keys, strict=True)]
    joined = placed.join(starts, same, "inner")
    return joined.select(*(placed[c] for c in rows.columns), (F.col(overall) - F.col(begins)).alias(name))
