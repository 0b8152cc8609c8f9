"""From price feeds to the product catalogue."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import is_sealed, normalize_product_id

DISCOVERY_COLUMNS = ("extRarity", "extNumber", "modifiedOn", "cleanName", "imageUrl")


def recent_only(feed: DataFrame, year: int = 2020) -> DataFrame:
    """Rows modified in ``year`` or later; an unreadable date drops the row.

    Files whose header has no modification date at all pass unfiltered. The reader
    records each file's header in ``feed_columns``.
    """
    if "modified_on" not in feed.columns:
        return feed
    recent = F.coalesce(F.year("modified_on") >= year, F.lit(False))
    if "feed_columns" in feed.columns:
        recent = recent | ~F.array_contains("feed_columns", "modifiedOn")
    return feed.filter(recent)


def missing_columns(headers: DataFrame, required=DISCOVERY_COLUMNS) -> DataFrame:
    """Sets whose feed lacks a required column, with the columns it lacks."""
    lacking = F.array_except(F.array(*[F.lit(c) for c in required]), "feed_columns")
    return (headers.select("set_code", lacking.alias("missing"))
            .filter(F.size("missing") > 0))


def require_columns(feed: DataFrame, required=DISCOVERY_COLUMNS) -> DataFrame:
    """Feed rows of the sets that have every required column."""
    present = F.forall(F.array(*[F.lit(c) for c in required]), lambda c: F.array_contains("feed_columns", c))
    return feed.filter(present)


def sealed_products(feed: DataFrame, year: int = 2020) -> DataFrame:
    return recent_only(feed, year).filter(is_sealed(F.col("ext_rarity"), F.col("ext_number")))


def catalogue_projection(feed: DataFrame) -> DataFrame:
    """Feed rows as catalogue rows: text dates, first tradable day = modification day."""
    day = F.coalesce(F.date_format("modified_on", "yyyy-MM-dd"), F.lit(""))
    return feed.select(
        normalize_product_id(F.col("product_id")).alias("product_id"), "name", "clean_name", "image_url",
        day.alias("modified_on"), day.alias("earliest_date"), "set_code",
        F.coalesce("url", F.lit("")).alias("url"))


def sealed_catalogue(feed: DataFrame, year: int = 2020) -> DataFrame:
    """The catalogue: recent sealed products of all sets."""
    return catalogue_projection(sealed_products(feed, year))


def catalogue_sample(catalogue: DataFrame, n: int = 5) -> DataFrame:
    """The first rows, by set and id."""
    return catalogue.orderBy("set_code", F.length("product_id"), "product_id").limit(n)


def sealed_counts(feed: DataFrame, year: int = 2020) -> DataFrame:
    """Sealed products per set. A set with recent rows but none sealed counts 0, a set
    without recent rows is left out."""
    sealed = is_sealed(F.col("ext_rarity"), F.col("ext_number"))
    return recent_only(feed, year).groupBy("set_code").agg(F.count_if(sealed).alias("sealed_products"))


def sealed_totals(counts: DataFrame) -> DataFrame:
    """Sealed products and sets over all of ``sealed_counts``."""
    return counts.agg(F.coalesce(F.sum("sealed_products"), F.lit(0)).alias("total_sealed"),
                      F.count("*").alias("sets_processed"))


def tracked_sets(products: DataFrame, newest: int | None = None) -> DataFrame:
    """Set codes of the catalogue in ascending order, or only the ``newest`` highest ones."""
    sets = products.select("set_code").distinct()
    if newest is not None:
        sets = sets.orderBy(F.col("set_code").desc()).limit(newest)
    return sets.orderBy("set_code")


def lookup_product(entries: DataFrame, products: DataFrame) -> DataFrame:
    """Entries with ``name``, ``earliest_date`` and ``known`` of their product.

    The catalogue has one row per product. Spark broadcasts it while it is small; beyond
    that the join is shuffled and AQE splits a product with very many entries.
    """
    facts = products.select("product_id", "name", "earliest_date", F.lit(True).alias("known"))
    return (entries.join(facts, "product_id", "left")
            .withColumn("known", F.coalesce("known", F.lit(False))))


def unknown_products(entries: DataFrame, products: DataFrame) -> DataFrame:
    """Entries whose product is not in the catalogue."""
    return entries.join(products, "product_id", "left_anti")
