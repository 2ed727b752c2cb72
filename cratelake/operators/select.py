"""Ordered selection: round robin, quotas, quantile strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratelake.staging import staged


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of the rows of each key the first in order. Spark keeps one row a key and task before it shuffles (its group limit), so
    that a key may hold any share of the rows."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def _on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys that may be null."""
    named = b.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond &= a[k].eqNullSafe(named[f"_on_{k}"])
    return a.join(named, cond, how).drop(*[f"_on_{k}" for k in keys])


def numbered(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """Adds ``out``, the row's number from 1 within its keys (without keys: in the whole table), without a task for a key.

    Rows are dealt into ranges of (keys, order), numbered inside their range and moved by what their key has in
    earlier ranges. The ranges are written before they are counted: a second evaluation would draw its
    bounds anew. A range has at most one key that began before it, so that the table of moves
    holds a row a range at most, whatever the keys are.

    Keys may be null; rows that tie in the order get numbers of their own, in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = staged(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    one = [F.col(k) for k in keys] or [F.lit(0)]
    sizes = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*one).orderBy("_range")) - F.col("_n"))
    moved = before.filter("_before > 0").select(*keys, "_range", "_before")
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    both = _on(cut.withColumn("_place", place), F.broadcast(moved), [*keys, "_range"], "left")
    return both.withColumn(out, F.col("_place") + F.coalesce("_before", F.lit(0))).drop("_place", "_before", "_range")


def round_robin(df: DataFrame, within: list, group: list[str], between: list, scope: list[str], limit: int | None = None) -> DataFrame:
    """Adds ``turn`` and ``place``: in each scope the first of every group, then the second, and so on.

    A group's rows are numbered in the order ``within``; rows of one turn follow ``between``. With a limit, rows
    of later turns than it can't be chosen and go before they are shuffled. Without one, turns and
    places are numbered by ranges, so that neither a group nor a scope is one task.
    """
    if limit is None:
        turns = numbered(df, [*scope, *group], within, "turn")
        return numbered(turns, scope, ["turn", *between], "place")
    turns = df.withColumn("turn", F.row_number().over(Window.partitionBy(*scope, *group).orderBy(*within))).filter(F.col("turn") <= limit)
    return turns.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy("turn", *between))).filter(F.col("place") <= limit)


def global_place(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds ``out``, the row's number from 1 in an order over all rows."""
    return numbered(df, [], order, out)


def first_seen(df: DataFrame, order: list[str], group: list[str], scope: list[str], limit: int) -> DataFrame:
    """Round robin whose groups come in the order in which they are first seen; adds ``place``."""
    g = df.withColumn("turn", F.row_number().over(Window.partitionBy(*scope, *group).orderBy(*order))).filter(F.col("turn") <= limit)
    lead = g.filter("turn = 1").select(*scope, *group, F.struct(*order).alias("_lead"))
    g = g.join(lead, [*scope, *group])
    return g.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy("turn", "_lead"))).filter(F.col("place") <= limit).drop("_lead")


def quota_fill(df: DataFrame, quotas: dict[str, int], group: list[str], most: int, any_role: bool = False) -> DataFrame:
    """Rows (path, role) of a crate with ``place``: each role's quota by round robin over the groups in the order of
    their first path, role after role, then up to ``most`` in all from what is left, of the quota roles in their order or
    (``any_role``) of all by path.

    A group gives no more rows than it could in any case, so that windows over what is left hold at most
    ``most`` rows of a group.
    """
    pos = F.coalesce(F.array_position(F.array(*map(F.lit, quotas)), F.col("role")), F.lit(0)).cast("int")
    quota = F.coalesce(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col("role")], F.lit(0))
    rows = df.withColumn("_pos", pos).withColumn("_quota", quota)
    first = first_seen(rows.filter("_pos > 0"), ["path"], group, ["role"], max(quotas.values())).filter(F.col("place") <= F.col("_quota"))
    first = first.select(*df.columns, F.lit(1).alias("_pass"), F.struct("_pos", "place").alias("_order"))
    left = rows.join(first.select("path"), "path", "left_anti")
    left = left.withColumn("_pos", F.lit(0)) if any_role else left.filter("_pos > 0")
    room = first.agg((F.lit(most) - F.count("*")).alias("_room"))
    more = first_seen(left.withColumn("_all", F.lit(0)), ["_pos", "path"], group, ["_all"], most).join(F.broadcast(room)).filter(F.col("place") <= F.col("_room"))
    more = more.select(*df.columns, F.lit(2).alias("_pass"), F.struct(F.lit(0).alias("_pos"), "place").alias("_order"))
    both = first.unionByName(more)
    return both.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_pass", "_order"))).filter(F.col("place") <= most).drop("_pass", "_order")


def stratified(df: DataFrame, value: str, group: Column, scope: list[str], size: int = 25, buckets: int = 5) -> DataFrame:
    """About ``size`` rows of each scope, spread over quantile buckets of ``value``; rows without a
    value are one more bucket; quotas by largest remainders; inside a bucket by round robin."""
    s = df.withColumn("_group", group).withColumn("_none", F.col(value).isNull())
    counts = df.groupBy(*scope).agg(F.count("*").alias("_n"), F.count(value).alias("_m"))
    s = numbered(_on(s, counts, scope), [*scope, "_none"], [value, "path"], "_rank")
    s = s.withColumn("_bucket", F.when(F.col("_none"), buckets).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("_rank") - 1) / F.ceil(F.col("_m") / buckets)))))
    sizes = s.groupBy(*scope, "_bucket").agg(F.count("*").alias("_size"), F.first("_n").alias("_n"))
    sizes = sizes.withColumn("_raw", F.lit(float(size)) * F.col("_size") / F.col("_n")).withColumn("_floor", F.floor("_raw"))
    sizes = sizes.withColumn("_short", size - F.sum("_floor").over(Window.partitionBy(*scope)))
    sizes = sizes.withColumn("_next", F.row_number().over(Window.partitionBy(*scope).orderBy((F.col("_raw") - F.col("_floor")).desc(), "_bucket")))
    quota = F.when(F.col("_n") <= size, F.col("_size")).otherwise(F.col("_floor") + (F.col("_next") <= F.col("_short")).cast("int"))
    s = s.join(sizes.select(*scope, "_bucket", quota.alias("_quota")), [*scope, "_bucket"])
    picked = round_robin(s, ["path"], ["_group"], ["path"], [*scope, "_bucket"], size).filter(F.col("place") <= F.col("_quota"))
    return picked.select(*df.columns, F.col("_bucket").cast("int").alias("bucket"))
