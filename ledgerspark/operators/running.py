"""Running totals that stay parallel when one key owns most of the rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A window group holds at most 2**BITS rows. Two levels of this width cover 2**40 order
# values per top group; a third level covers the whole bigint range.
BITS = 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by key to as many tasks as the session shuffles to. Windows are much work for the few
    bytes that narrow rows have, so the tasks are not put together by bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def running_totals(df: DataFrame, keys: list[str], order: str, values: dict[str, str],
                   bits: int = BITS, levels: int = 2) -> DataFrame:
    """Add, per row, the sum of each value over the key's rows *before* it.

    ``order`` is an integer column, unique within a key; keys and order are never null.
    ``values`` maps a bigint column to the name of its total. A plain window would put a
    whole key into one task. Here the order values are cut into ranges of 2**bits: each
    range is summed (combined on the map side), the range sums are accumulated the same
    way one level up, and a window inside (key, range), hence over at most 2**bits rows,
    adds the rest.
    """
    def before(names) -> list:
        window = (Window.partitionBy(*names).orderBy(order)
                  .rowsBetween(Window.unboundedPreceding, -1))
        return [F.coalesce(F.sum(v).over(window), F.lit(0)).alias(t) for v, t in values.items()]

    if levels == 0:
        return df.select("*", *before(keys))
    part = f"{order}_range"
    ranged = df.withColumn(part, F.shiftright(order, bits))
    sums = ranged.groupBy(*keys, part).agg(*[F.sum(v).alias(v) for v in values])
    offsets = running_totals(sums, keys, part, {v: f"{t}_offset" for v, t in values.items()},
                             bits, levels - 1).select(*keys, part, *[f"{t}_offset" for t in values.values()])
    # The join and the window share their keys, so the rows are shuffled once for both.
    joined = spread(ranged, *keys, part).join(offsets.hint("shuffle_hash"), [*keys, part]).select("*", *before([*keys, part]))
    return joined.select(*df.columns, *[(F.col(t) + F.col(f"{t}_offset")).alias(t) for t in values.values()])
