"""Price snapshots: daily Parquet files as collected, and the table they end up in."""

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import finite_price, normalize_product_id
from ledgerspark.operators.snapshots import dedupe_snapshot, skip_existing
from ledgerspark.schemas import SNAPSHOTS
from ledgerspark.sources.files import read_if_there

FILE_DATE = r"^market_prices_([0-9]{4}-[0-9]{2}-[0-9]{2})\.parquet$"
FILES = "market_prices_*.parquet"


def _id_types(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Type of the id column according to each file's footer; runs inside tasks."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq
    for batch in files:
        types = []
        for path in batch["path"]:
            uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
            system, inner = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
            with system.open_input_file(inner) as handle:
                schema = pq.read_schema(handle)
            types.append("bigint" if str(schema.field("productId").type).startswith(("int", "uint")) else "string")
        yield pd.DataFrame({"path": batch["path"], "id_type": types})


def file_date(name=None):
    """The day in a snapshot's file name, null when the name is not of that form."""
    name = F.col("_metadata.file_name") if name is None else name
    return F.try_to_date(F.regexp_extract(name, FILE_DATE, 1))


def snapshot_rows(raw: DataFrame) -> DataFrame:
    """Rows of snapshot files under the engine's names, with the place they have in their file;
    files with other names are skipped."""
    return (raw.select(normalize_product_id(F.col("productId")).alias("product_id"),
                       file_date().alias("snapshot_date"),
                       finite_price(F.col("marketPrice").cast("double")).alias("market_price"),
                       F.col("_metadata.file_path").alias("file_path"),
                       F.col("_metadata.file_modification_time").alias("modified"),
                       F.col("_metadata.row_index").alias("position"))
            .filter(F.col("snapshot_date").isNotNull()))


def read_price_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """All ``market_prices_<date>.parquet`` files of a folder; the first row of a product and day counts.

    Files with other names are not opened.
    """
    listing = read_if_there(lambda: spark.read.format("binaryFile").option("pathGlobFilter", FILES).load(folder))
    files = listing.inputFiles() if listing is not None else []
    files = [f for f in files if re.search(FILE_DATE, f.rsplit("/", 1)[-1])]
    if not files:
        return spark.createDataFrame([], SNAPSHOTS)
    return dedupe_snapshot(read_snapshot_files(spark, files), ["file_path", "position"]).select(*SNAPSHOTS.fieldNames())


def read_snapshot_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """``snapshot_rows`` of the given files, of which there is about one per day.

    Older files store ids as integers, newer ones as text, and Parquet columns cannot be
    read as another type. The footers are looked at in parallel and each kind is read
    with its own schema.
    """
    tasks = min(len(files), spark.sparkContext.defaultParallelism)
    spread = spark.createDataFrame([(f,) for f in files], "path string").repartition(tasks)
    typed = spread.mapInPandas(_id_types, "path string, id_type string").collect()
    parts = []
    for id_type in ("string", "bigint"):
        paths = [row.path for row in typed if row.id_type == id_type]
        if paths:
            schema = f"productId {id_type}, marketPrice double"
            parts.append(snapshot_rows(spark.read.schema(schema).parquet(*paths)))
    return reduce(DataFrame.unionByName, parts)


def read_snapshot_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored snapshots, partitioned by day; empty before the first write."""
    stored = read_if_there(lambda: spark.read.schema(SNAPSHOTS).parquet(path))
    if stored is None:
        return spark.createDataFrame([], SNAPSHOTS)
    return stored.select("product_id", "snapshot_date", "market_price")


def write_price_snapshot(snapshot: DataFrame, path: str, force: bool = False) -> None:
    """Store snapshots by day. Days that are stored already are skipped unless forced, and
    then replaced whole. Rows are rebalanced by day, which splits a day that is much larger
    than the others over several files. A column ``modified``, the time of the file a day came
    from, is stored along with it."""
    if not force:
        snapshot = skip_existing(snapshot, read_snapshot_table(snapshot.sparkSession, path))
    more = [c for c in ("modified",) if c in snapshot.columns]
    (snapshot.select("product_id", F.col("market_price").cast("double").alias("market_price"), *more, "snapshot_date")
     .hint("rebalance", "snapshot_date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
     .partitionBy("snapshot_date").parquet(path))
