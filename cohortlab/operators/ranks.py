"""Ranks and running sums over a whole order, spread over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def running(df: DataFrame, order: list[Column | str], by: list[str] | tuple[str, ...] = (), **sums: Column | str) -> DataFrame:
    """df with a column for each of sums: the sum of that expression over all rows of the group that come earlier.

    Rows are dealt out by ranges of (by, order), so that a group of any size is spread over many tasks; each range is summed
    up on its own, and begins where the group's earlier ranges end. Rows that tie in the order come one after another."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    places, values = [f"__o{i}" for i in range(len(order))], [f"__v{i}" for i in range(len(sums))]
    keyed = df.withColumns(dict(zip(places, order, strict=True))).withColumns({v: F.expr(x) if isinstance(x, str) else x for v, x in zip(values, sums.values(), strict=True)})
    # written, so that both readers below see the same ranges
    dealt = written(keyed.repartitionByRange(*by, *places).withColumn("__range", F.spark_partition_id()), "ranges")
    group = ["__range", *by]
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range and group: no more than the two together
    begins = dealt.groupBy(*group).agg(*(F.sum(v).alias(f"__s{i}") for i, v in enumerate(values)))
    begins = begins.select(*group, *(F.coalesce(F.sum(f"__s{i}").over(ahead), F.lit(0)).alias(f"__b{i}") for i in range(len(values))))
    begins = begins.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(group)), *(f"__b{i}" for i in range(len(values))))
    inside = Window.partitionBy(*group).orderBy(*places).rowsBetween(Window.unboundedPreceding, -1)
    same = F.lit(True)
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = dealt.join(begins, same).withColumns({name: F.col(f"__b{i}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for i, (name, v) in enumerate(zip(sums, values, strict=True))})
    return out.select(*df.columns, *sums)


def rank(df: DataFrame, order: list[Column | str], by: list[str] | tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """df with its rows numbered from 1 within groups."""
    out = running(df, order, by, **{name: F.lit(1)})
    return out.withColumn(name, (F.col(name) + 1).cast("long"))


def first_of(df: DataFrame, n: int, order: list[Column | str], by: str, name: str, parts: int = 64) -> DataFrame:
    """The first n rows of each group, numbered from 1: first those of parts of a group, then those of what is left."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    part = F.pmod(F.xxhash64(*order), F.lit(parts))
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(by, part).orderBy(*order))).where(F.col(name) <= n)
    return out.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= n)
