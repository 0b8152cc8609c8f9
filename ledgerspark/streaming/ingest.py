"""Snapshot files picked up as they arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerspark.functions.state import cut_lineage
from ledgerspark.operators.snapshots import dedupe_snapshot
from ledgerspark.plans.incremental import PortfolioStore
from ledgerspark.schemas import SNAPSHOTS
from ledgerspark.sources.files import read_if_there
from ledgerspark.sources.snapshots import (FILES, file_date, read_snapshot_files, read_snapshot_table,
                                           write_price_snapshot)

_FILE = "path string, modificationTime timestamp, length long, content binary"
_STORED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SNAPSHOTS) + ", modified timestamp"


def newest_files(files: DataFrame, table: str) -> list[str]:
    """The newest of ``files`` (path, modified) per day, unless the stored day is newer still.

    The path settles equal times. Files are compared on one small row each, never row by row, and
    one path per day comes to the driver.
    """
    dated = (files.withColumn("snapshot_date", file_date(F.element_at(F.split("path", "/"), -1)))
             .filter(F.col("snapshot_date").isNotNull()))
    newest = dated.groupBy("snapshot_date").agg(F.max(F.struct("modified", "path")).alias("newest"))
    stored = read_if_there(lambda: files.sparkSession.read.schema(_STORED).parquet(table))
    if stored is not None:
        days = stored.groupBy("snapshot_date").agg(F.max("modified").alias("taken"))
        newest = (newest.join(days, "snapshot_date", "left")
                  .filter(F.col("taken").isNull() | (F.col("newest.modified") >= F.col("taken"))))
    return [row.path for row in newest.select("newest.path").collect()]


def _valued(rows: DataFrame, table: str, store: PortfolioStore) -> None:
    """Hand the days to the portfolio, the file's time saying which of two prices is the newer one.

    A product that a day had before and has no longer loses its price on it. The portfolio comes before the
    table: should the table's write fail, the day is still known as it was when the batch is run again.
    """
    days = rows.groupBy("snapshot_date").agg(F.max("modified").alias("modified"))
    before = read_snapshot_table(rows.sparkSession, table).select("product_id", "snapshot_date").join(days, "snapshot_date")
    gone = (before.join(rows.select("product_id", "snapshot_date"), ["product_id", "snapshot_date"], "left_anti")
            .withColumn("market_price", F.lit(None).cast("double")))
    names = ["product_id", "snapshot_date", "market_price", "modified"]
    store.add_prices(rows.select(*names).unionByName(gone.select(*names)), F.unix_micros("modified"))


def _store(table: str, store: PortfolioStore | None):
    def write(batch: DataFrame, _batch_id: int) -> None:
        # A day is replaced whole, so a batch that is run again after a failure ends the same.
        files = newest_files(batch, table)
        if files:
            rows = dedupe_snapshot(read_snapshot_files(batch.sparkSession, files), ["position"])
            if store is not None:
                rows = cut_lineage(rows)
                _valued(rows, table, store)
            write_price_snapshot(rows, table, force=True)
    return write


def ingest_snapshots_stream(spark: SparkSession, folder: str, table: str, checkpoint: str,
                            max_files: int | None = None, store: PortfolioStore | None = None) -> StreamingQuery:
    """Move new ``market_prices_<date>.parquet`` files, with ids as text or integers, into the snapshot table.

    Every file is taken once and holds a whole day. A day that is sent again has to come
    under a new path, such as another folder below ``folder``; the newest file of a day counts,
    whichever batch or run it arrives in. ``max_files`` limits a batch, not the result. With a ``store`` every
    batch goes on into its daily values, without a rebuild. The query ends when nothing new is left.
    """
    reader = (spark.readStream.format("binaryFile").schema(_FILE)
              .option("pathGlobFilter", FILES).option("recursiveFileLookup", "true"))
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # Without the content column only the listing is read.
    files = reader.load(folder).select("path", F.col("modificationTime").alias("modified"))
    return (files.writeStream.foreachBatch(_store(table, store)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
