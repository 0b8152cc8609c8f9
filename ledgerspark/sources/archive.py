"""Archived prices: one JSON document per day and set."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "results array<struct<productId:string,marketPrice:string>>"


def read_price_archive_json(spark: SparkSession, root: str, category: str = "3") -> DataFrame:
    """Rows of ``<root>/<date>/<category>/<set>/prices``.

    Documents whose ``results`` is not a list contribute nothing. ``position`` is the
    place of a row in its document; prices stay text until ``clean_price``.
    """
    path = F.col("_metadata.file_path")
    return (spark.read.schema(_SCHEMA).option("multiLine", True).json(f"{root}/*/{category}/*/prices")
            .select(F.try_to_date(F.regexp_extract(path, r"/([^/]+)/[^/]+/[^/]+/prices$", 1)).alias("snapshot_date"),
                    F.regexp_extract(path, r"/([^/]+)/prices$", 1).try_cast("int").alias("set_code"),
                    F.posexplode("results").alias("position", "row"))
            .filter(F.col("snapshot_date").isNotNull())
            .select("snapshot_date", "set_code", F.col("row.productId").alias("product_id"),
                    F.col("row.marketPrice").alias("market_price"), "position"))
