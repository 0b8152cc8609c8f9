"""Catalogue CSV and id list."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import strip
from ledgerspark.schemas import CATALOGUE_CSV, PRODUCTS
from ledgerspark.sources.files import read_if_there


def _csv(reader, header: bool = True):
    return reader.option("header", header).option("escape", '"').option("multiLine", True)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue; a missing file is an empty catalogue. Unreadable dates become null.

    Columns are found by name, in any order; all but the id may be absent and are null then. The
    files of a folder share one header.
    """
    found = read_if_there(lambda: _csv(spark.read).csv(path))
    if found is None or not found.columns:
        return spark.createDataFrame([], PRODUCTS)
    # enforceSchema=False makes Spark compare every file's header with the first one.
    raw = _csv(spark.read.schema(found.schema).option("enforceSchema", False)).csv(path)
    have = {name: F.col(f"`{name}`") if name in raw.columns or name == "productId" else F.lit(None).cast("string")
            for name in CATALOGUE_CSV}
    return raw.select(
        have["productId"].alias("product_id"), have["name"].alias("name"), have["cleanName"].alias("clean_name"),
        have["imageUrl"].alias("image_url"), F.try_to_date(have["modifiedOn"]).alias("modified_on"),
        F.try_to_date(have["earliestDate"]).alias("earliest_date"),
        have["set_code"].try_cast("int").alias("set_code"), have["url"].alias("url"))


def write_products_csv(catalogue: DataFrame, path: str) -> None:
    """The catalogue as CSV files with a header, under the names the reader expects."""
    columns = ("product_id", "name", "clean_name", "image_url", "modified_on", "earliest_date", "set_code", "url")
    named = catalogue.select(*[F.col(c).alias(n) for c, n in zip(columns, CATALOGUE_CSV)])
    named.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank ids, one per line."""
    return (spark.read.text(path).select(strip(F.col("value")).alias("product_id"))
            .filter(F.col("product_id") != "").distinct())


def write_id_list(ids: DataFrame, path: str) -> None:
    ids.select(F.col("product_id").cast("string").alias("value")).write.mode("overwrite").text(path)
