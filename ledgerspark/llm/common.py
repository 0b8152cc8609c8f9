"""Helpers shared by the text operators: stored tables, prefix sums, connected components."""

import sys
import types
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.state import cut_lineage as stored

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def per_worker(slot: str, key: str, make: Callable):
    """What ``make`` returns for ``key``, kept by the Python worker that runs a task for its later tasks.

    A slot holds one thing: another key takes the place of what was there.
    """
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if slot not in kept or kept[slot][0] != key:
        kept.pop(slot, None)
        kept[slot] = key, make()
    return kept[slot][1]


def count_words(text):
    """Number of words of a text column; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the same ``group``.

    The rows are range-sorted by group and order, each partition keeps its own running
    sums, and the totals of a group's earlier partitions are added. A group with most of
    the rows is thereby spread over many tasks. ``group`` must not be null; rows that tie
    in ``order`` may swap.
    """
    placed = stored(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.join(before, [group, "_part"])
            .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("_part", "_before"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges ``a``, ``b`` (long): rows ``node``, ``root`` of all linked nodes.

    ``root`` is the smallest node of the component. Large-star and small-star steps alternate
    until the edges no longer change; every round is written to the shared folder.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.union(least).distinct())
        mark, last = _mark(now), mark
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
