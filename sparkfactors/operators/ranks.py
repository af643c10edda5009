"""Places of rows in an order, without one task that sees all of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut


def ranked(df: DataFrame, order: tuple[str, ...], within: tuple[str, ...] = (), name: str = "rank", size: str | None = None, group: str | None = None, overall: str | None = None) -> DataFrame:
    """df with name: the row's place (long, from 0) in the order of columns, of each `within` group or of all rows; with
    size: the rows of its group; with group: the place of the group among groups; with overall: the place among all rows.

    Rows are dealt by ranges of within and order and sorted in their tasks, so a group of any size is spread over many of
    them. A row's place is that in its range plus the sizes of the group's earlier ranges, a table of one row per range
    and group that begins in it. Nulls come first. Rows that agree in within and order share a range and get places in
    any order: give order a last column that tells rows apart wherever that matters. An empty table gives an empty one.
    """
    keys = [f"__w{i}" for i in range(len(within))]
    rows = df.repartitionByRange(*(F.col(c) for c in (*within, *order))).sortWithinPartitions(*within, *order)
    rows = cut(rows.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    sizes = rows.groupBy("__part", *(F.col(c).alias(k) for c, k in zip(within, keys, strict=True))).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    of_group = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"__start": F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first"), "__size": F.sum("__n").over(of_group)})
    more = {size: F.col("__size")} if size else {}
    if group:
        sizes = cut(sizes)
        groups = ranked(sizes.select(*keys).distinct(), tuple(keys), name="__group").withColumnsRenamed({k: f"{k}g" for k in keys})
        sizes = sizes.join(groups, _same(keys, [f"{k}g" for k in keys])).drop(*(f"{k}g" for k in keys))
        more[group] = F.col("__group")
    if overall:
        # A row for each range of rows.
        parts = sizes.groupBy("__part").agg(F.sum("__n").alias("__m"))
        ahead = F.sum("__m").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
        sizes = sizes.join(parts.select("__part", F.coalesce(ahead, F.lit(0)).alias("__ahead")), "__part")
        more[overall] = F.col("__ahead") + F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    sizes = sizes.withColumnRenamed("__part", "__range")
    out = rows.join(sizes, (F.col("__part") == F.col("__range")) & _same(within, keys))
    return out.select(*df.columns, (F.col("__at") + F.col("__start")).cast("long").alias(name), *(v.cast("long").alias(k) for k, v in more.items()))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)), F.lit(True))


def quantiles(df: DataFrame, value: str, at: Sequence[float], within: tuple[str, ...] = ()) -> DataFrame:
    """within, e: the exact quantiles (array, linear between neighbours) of a column; nulls are left out.

    Only the few rows at the places wanted leave the sorted ranges.
    """
    rows = ranked(df.select(*within, value).where(F.col(value).isNotNull()), (value,), within, name="__r", size="__n")
    qs = F.array(*(F.lit(float(q)) for q in at))
    places = lambda f: F.transform(qs, lambda q: f(q * (F.col("__n") - 1)).cast("long"))
    picked = rows.where(F.array_contains(places(F.floor), F.col("__r")) | F.array_contains(places(F.ceil), F.col("__r")))
    known = picked.groupBy(*within, "__n").agg(F.map_from_entries(F.collect_list(F.struct("__r", value))).alias("__v"))

    def between(q: Column) -> Column:
        p = q * (F.col("__n") - 1)
        low, high = F.floor(p), F.ceil(p)
        v = lambda i: F.element_at("__v", i.cast("long"))
        return F.when(low == high, v(low)).otherwise((high - p) * v(low) + (p - low) * v(high))

    return known.select(*within, F.transform(qs, between).alias("e"))
