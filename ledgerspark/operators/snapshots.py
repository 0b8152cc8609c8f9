"""Building, checking and describing price snapshots."""

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import clean_price, normalize_product_id
from ledgerspark.operators.catalogue import recent_only
from ledgerspark.schemas import PRICE


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key. A row-number limit of 1 is applied inside each map task
    before the shuffle, so a key with very many copies arrives as one row per task."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def dedupe_snapshot(rows: DataFrame, order: list[str]) -> DataFrame:
    """One price per product and day: the first in ``order``, even when it is null."""
    return first_rows(rows, ["product_id", "snapshot_date"], order)


def keep_tracked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of tracked products. Spark broadcasts the id list when it is small enough."""
    return rows.join(ids, "product_id", "left_semi")


def snapshot_from_feed(feed: DataFrame, products: DataFrame, snapshot_date: date, year: int = 2020) -> DataFrame:
    """One row per tracked product with its price in the feed of its set.

    The first recent feed row of a product counts. Products without one, and all products
    of a set whose feed did not arrive, get a null price. A product listed under several
    sets is looked up in the first. ``row_no`` orders the feed; without it the price does.
    """
    tracked = first_rows(products.select("product_id", "set_code"), ["product_id"], ["set_code"])
    order = ["row_no"] if "row_no" in feed.columns else ["market_price"]
    offers = first_rows(
        recent_only(feed, year).withColumn("product_id", normalize_product_id(F.col("product_id"))),
        ["set_code", "product_id"], order).select("set_code", "product_id", "market_price")
    return (tracked.join(offers, ["set_code", "product_id"], "left")
            .select("product_id", F.lit(snapshot_date).alias("snapshot_date"),
                    clean_price(F.col("market_price")).alias("market_price")))


def snapshot_from_archive(archive: DataFrame, ids: DataFrame, order: list[str]) -> DataFrame:
    """Snapshots of past days out of archive rows: tracked products, one row each per day."""
    cleaned = archive.withColumn("market_price", clean_price(F.col("market_price")))
    return (dedupe_snapshot(keep_tracked(cleaned, ids), order)
            .select("product_id", "snapshot_date", "market_price"))


def skip_existing(snapshot: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Rows of days that are not stored yet, or all of them when forced."""
    return snapshot if force else snapshot.join(
        existing.select("snapshot_date").distinct(), "snapshot_date", "left_anti").select(*snapshot.columns)


def missing_snapshot_dates(existing: DataFrame, start: date, end: date) -> DataFrame:
    """Days from ``start`` to ``end``, both included, without a stored snapshot."""
    days = existing.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end))).alias("snapshot_date"))
    return days.join(existing.select("snapshot_date").distinct(), "snapshot_date", "left_anti")


def _medians(priced: DataFrame) -> DataFrame:
    """Exact median per day without gathering a day's prices in one place.

    Prices are counted per value, the counts per whole unit of currency; the running
    count over units tells in which unit the middle lies, and only the values of that
    unit are ranked. A unit holds at most a million distinct six-place values.
    """
    day = Window.partitionBy("snapshot_date")
    counts = (priced.groupBy("snapshot_date", "price").agg(F.count("*").alias("n"))
              .withColumn("unit", F.floor("price").cast("bigint")))
    upto = Window.partitionBy("snapshot_date").orderBy("unit")
    units = (counts.groupBy("snapshot_date", "unit").agg(F.sum("n").alias("n"))
             .select("snapshot_date", "unit", F.sum("n").over(upto).alias("through"), F.col("n").alias("here"),
                     F.sum("n").over(day).alias("total"))
             .withColumn("before", F.col("through") - F.col("here"))
             .withColumn("low", F.floor((F.col("total") - 1) / 2))
             .withColumn("high", F.floor(F.col("total") / 2))
             .filter((F.col("before") <= F.col("high")) & (F.col("through") > F.col("low")))
             .select("snapshot_date", "unit", "before", "low", "high"))
    inside = Window.partitionBy("snapshot_date", "unit").orderBy("price")
    ranked = (counts.join(units, ["snapshot_date", "unit"])
              .withColumn("through", F.col("before") + F.sum("n").over(inside))
              .withColumn("start", F.col("through") - F.col("n")))

    def at(rank: str):
        return F.max(F.when((F.col("start") <= F.col(rank)) & (F.col("through") > F.col(rank)), F.col("price")))
    return (ranked.groupBy("snapshot_date").agg(at("low").alias("a"), at("high").alias("b"))
            .select("snapshot_date", ((F.col("a").cast("double") + F.col("b").cast("double")) / 2)
                    .alias("median_price")))


def snapshot_stats(snapshot: DataFrame) -> DataFrame:
    """Per day: rows, rows with a price, mean, exact median, lowest and highest price, and
    the number of sets where the rows carry a set code."""
    priced = snapshot.withColumn("price", F.col("market_price").cast(PRICE))
    sets = [F.count_distinct("set_code").alias("sets_found")] if "set_code" in snapshot.columns else []
    basics = priced.groupBy("snapshot_date").agg(
        F.count("*").alias("total_rows"), F.count("price").alias("valid_rows"),
        F.sum("price").alias("price_sum"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        *sets)
    return (basics.join(_medians(priced.filter(F.col("price").isNotNull())), "snapshot_date", "left")
            .select("snapshot_date", "total_rows", "valid_rows",
                    (F.col("price_sum").cast("double") / F.col("valid_rows")).alias("mean_price"),
                    "median_price", "min_price", "max_price", *[c for c in ("sets_found",) if sets]))
