"""Current price feeds: one CSV per product set."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import normalize_product_id
from ledgerspark.schemas import FEED_COLUMNS

SET_IN_PATH = r"/([0-9]+)/[^/]*$"
# A record ends with its line unless that is inside quotes; a value is what stands between commas outside quotes.
RECORD = r'(?:[^"\r\n]++|"(?:[^"]++|"")*+")++'
FIELD = r',((?:[^,"]++|"(?:[^"]++|"")*+")*+)'


def _set_code(path, pattern: str):
    return F.regexp_extract(path, pattern, 1).try_cast("int")


def read_feed_headers(spark: SparkSession, path: str, set_pattern: str = SET_IN_PATH) -> DataFrame:
    """(file_path, set_code, feed_columns): the header of every feed file.

    Only the first line of a file's first block can be the header; tasks keep one line
    per file before anything is shuffled.
    """
    lines = (spark.read.text(path)
             .select("value", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_block_start").alias("block_start"))
             .filter(F.col("block_start") == 0)
             .withColumn("line_no", F.monotonically_increasing_id()))
    first = lines.groupBy("file_path").agg(F.min_by("value", "line_no").alias("header"))
    names = F.transform(F.split(F.regexp_replace("header", "^\ufeff", ""), ","),
                        lambda c: F.trim(F.regexp_replace(c, '"', "")))
    return first.select("file_path", _set_code(F.col("file_path"), set_pattern).alias("set_code"),
                        names.alias("feed_columns"))


def _fields(record: Column) -> Column:
    """The values of one CSV record; an empty value that is not quoted is null."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD), 1)
    return F.transform(raw, lambda v: F.when(F.startswith(v, F.lit('"')), F.replace(
        F.substr(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).when(v != "", v))


def read_price_feed_csv(spark: SparkSession, path: str, set_pattern: str = SET_IN_PATH) -> DataFrame:
    """Feed rows of all sets under the engine's column names; columns a file lacks are null.

    Headers differ from file to file. Every file is read whole (a feed is one set's products) and split
    into records and values by expressions, and values are taken by the place their name has in the
    file's own header: one plan, whatever the numbers of files and headers. Prices stay text until
    ``clean_price``. ``feed_columns`` is the header of the row's file and ``row_no`` follows the order of its rows.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract_all("value", F.lit(RECORD), 0).alias("records"), F.col("_metadata.file_path").alias("file_path"))
    header = F.transform(_fields(F.regexp_replace(F.get("records", F.lit(0)), "^\ufeff", "")), lambda c: F.trim(c))
    rows = (files.filter(F.size("records") > 1)
            .select("file_path", header.alias("feed_columns"),
                    F.explode(F.slice("records", F.lit(2), F.size("records"))).alias("record"))
            .select("file_path", "feed_columns", _fields(F.col("record")).alias("fields"),
                    F.monotonically_increasing_id().alias("row_no")))
    named = {alias: F.get("fields", F.coalesce(F.array_position("feed_columns", name), F.lit(0)).cast("int") - 1)
             for name, alias in FEED_COLUMNS.items()}
    feed = rows.select(*[value.alias(alias) for alias, value in named.items()],
                       _set_code(F.col("file_path"), set_pattern).alias("set_code"), "feed_columns", "row_no")
    return (feed.withColumn("product_id", normalize_product_id(F.col("product_id")))
            .withColumn("modified_on", F.to_date(F.try_to_timestamp("modified_on"))))
