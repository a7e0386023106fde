"""Running totals and dense numbers of a sorted table.

A window over a whole table, or over one group that may be a third of it, is one
task. Here the table is range-partitioned in order and every partition totals its own
part of a group; what a part has before it is the sum of a few numbers, one for each
partition that the group goes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentria.shared import written

_PLACE, _PART, _ALL = "__place", "__part", "__all"
#: kind of total -> how values are gathered, and how two gathered values become one
KINDS = {"sum": (F.sum, lambda a, b: a + b, 0), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0)}


def running(df: DataFrame, by: list[str], order: list[Column], totals: dict[str, tuple[str, Column]], whole: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a running total for each name in ``totals`` (kind, long column), the
    row itself included, within the groups of ``by`` in ``order``; for the names in
    ``whole`` also the total of the group, as ``<name>_all``.

    Rows that are equal in ``by`` and ``order`` stand in any order. The sorted rows
    are stored once. Broadcast is only what groups carry from partition to partition,
    no more rows than twice the partitions.
    """
    groups = by or [_ALL]
    if not by:
        df = df.withColumn(_ALL, F.lit(0))
    keys = [F.col(c).asc_nulls_first() for c in by] + order
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_PLACE, F.monotonically_increasing_id())
    # the upper bits of that number are the partition's, the lower count its rows
    rows = written(rows.withColumn(_PART, F.shiftright(_PLACE, 33)), "ranged")
    named = {name: (KINDS[kind], column.cast("long")) for name, (kind, column) in totals.items()}

    own = F.struct(*groups)
    ends = rows.groupBy(_PART).agg(F.min_by(own, _PLACE).alias("first"), F.max_by(own, _PLACE).alias("last"))
    ends = written(ends, "ends")  # a row a partition
    crossing = ends.select("first.*").intersect(ends.select("last.*"))
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    parts = rows.join(F.broadcast(crossing), same(rows, crossing, groups), "left_semi")
    parts = parts.groupBy(*groups, _PART).agg(*(gather(column).alias(name) for name, ((gather, _, _), column) in named.items()))
    before = Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*groups)
    carried = parts.select(
        *(F.col(c).alias(f"__{c}") for c in (*groups, _PART)),
        *(F.coalesce(gather(name).over(before), F.lit(zero).cast("long")).alias(f"__before_{name}") for name, ((gather, _, zero), _) in named.items()),
        *(named[name][0][0](name).over(every).alias(f"__all_{name}") for name in whole),
    )
    carried = written(carried, "carried")
    met = rows.join(F.broadcast(carried), [rows[c].eqNullSafe(carried[f"__{c}"]) for c in (*groups, _PART)], "left")
    local = Window.partitionBy(_PART, *groups)
    upto = local.orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    added = {name: add(gather(column).over(upto), F.coalesce(F.col(f"__before_{name}"), F.lit(zero).cast("long"))) for name, ((gather, add, zero), column) in named.items()}
    added |= {f"{name}_all": F.coalesce(F.col(f"__all_{name}"), named[name][0][0](named[name][1]).over(local)) for name in whole}
    return met.select(*(c for c in df.columns if c != _ALL), *(column.alias(name) for name, column in added.items()))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the number of each row in ``order``, from 0, without a gap: the same
    for every partitioning, if no two rows are equal in ``order``.

    The rows are sorted in range partitions and stored; a row's number is its place in
    its partition and the sizes of those before, so it moves no further.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_PLACE, F.monotonically_increasing_id())
    rows = written(rows.withColumn(_PART, F.shiftright(_PLACE, 33)), "ranged", compression="zstd")
    sizes = rows.groupBy(_PART).agg(F.count("*").alias("__size"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = written(sizes.select(_PART, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")), "starts")
    number = F.col("__start") + F.col(_PLACE).bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(starts), _PART).select(*df.columns, number.alias(name))
