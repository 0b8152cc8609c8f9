"""Tables that are replaced as a whole or updated by key.

A table is a folder of ``version=N`` folders. A write goes into a folder of its own and becomes a version by
one rename, so the version being read is never touched, a failed write leaves the old one in place, and
of two writers that want the same version one fails. Tables in buckets are updated in place: rows are dealt to
``bucket=K`` folders by key, and an update writes only the buckets that it touches.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.state import cut_lineage
from ledgerspark.schemas import LEDGER
from ledgerspark.sources.files import delete_folder, finished_versions, is_finished, move_folder, newest_version, read_if_there

# Versions that stay after a write: readers of the one before may still be at work.
KEPT = 2


class VersionTaken(RuntimeError):
    """Another writer has stored the version that this write was to become."""


def replace_table(df: DataFrame, root: str, based_on: int | None = None, keep: int = KEPT) -> int:
    """Store ``df`` as the next version of the table and return its number; an empty frame clears the table.

    With ``based_on``, the version that ``df`` was made from (0 for none), the write only succeeds if no other
    has come in between, else it raises ``VersionTaken`` and changes nothing. Without it the write
    takes the next free version. All but the newest ``keep`` versions are removed.
    """
    spark = df.sparkSession
    if based_on is not None and (newest_version(spark, root) or 0) != based_on:
        raise VersionTaken(f"{root} is no longer at version {based_on}")
    own = f"{root}/_writing-{uuid.uuid4()}"
    try:
        df.write.parquet(own)
        version = 1 + (newest_version(spark, root) or 0 if based_on is None else based_on)
        while not move_folder(spark, own, f"{root}/version={version}"):
            if not is_finished(spark, f"{root}/version={version}"):
                # Finished folders get the name in one piece: this one is what a broken write left.
                delete_folder(spark, f"{root}/version={version}")
            elif based_on is not None:
                raise VersionTaken(f"{root} has a version {version} already")
            else:
                version += 1
    finally:
        delete_folder(spark, own)
    for old in finished_versions(spark, root)[max(keep, 1):]:
        delete_folder(spark, f"{root}/version={old}")
    return version


def read_table(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The newest version; an empty frame when there is none but a schema is given."""
    newest = newest_version(spark, root)
    if newest is None:
        if schema is None:
            raise ValueError(f"no table at {root}")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/version={newest}")


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """All transactions. Rows come unordered: every operator that cares orders by
    (transaction_date, created_at, transaction_id) itself."""
    return read_table(spark, root, LEDGER)


def upsert_by_key(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` inserted, or put in place of those with the same key.

    ``changes`` has one row per key. Null is a key like any other.
    """
    same = [F.col(f"old.{key}").eqNullSafe(F.col(f"new.{key}")) for key in keys]
    kept = base.alias("old").join(changes.select(*keys).alias("new"), same, "left_anti")
    return kept.unionByName(changes.select(*base.columns))


@dataclass(frozen=True)
class BucketTable:
    """Rows in ``bucket=K`` folders by a hash of the ``by`` columns; ``count`` must not change afterwards.

    ``schema`` is DDL without the bucket. An update replaces whole buckets, each by a rename at the end of its
    write; one that breaks off leaves every bucket as it was or as it shall be, and can be run again.
    """

    spark: SparkSession
    root: str
    schema: str
    by: tuple[str, ...]
    count: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.count)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows with their ``bucket``; only the folders of the named buckets are opened."""
        rows = read_if_there(lambda: self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.root))
        if rows is None:
            rows = self.spark.createDataFrame([], f"{self.schema}, bucket int")
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that these rows belong to: no more than the table has."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """Make ``rows`` (with their ``bucket``) all that the named buckets hold; the others keep their files."""
        rows = cut_lineage(rows)  # the buckets may be read while they are replaced
        names = [r[0] for r in rows.select("bucket").distinct().collect()]
        # Rebalancing splits a bucket that is much larger than the others over several files.
        (rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(self.root))
        for empty in set(buckets) - set(names):
            delete_folder(self.spark, f"{self.root}/bucket={empty}")

    def append(self, rows: DataFrame) -> None:
        """Add rows to their buckets in new files."""
        (rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
         .write.mode("append").partitionBy("bucket").parquet(self.root))

    def upsert(self, changes: DataFrame, keys: list[str], deleted: DataFrame | None = None) -> list[int]:
        """Insert rows, replace those with the same ``keys``, take out ``deleted`` (``by`` columns and keys).

        ``by`` columns never change for a key. Only touched buckets are read and written; returns them.
        """
        columns = [f for f in self.read().columns if f != "bucket"]
        changes = changes.select(*columns).withColumn("bucket", self.bucket())
        touched = set(self.buckets_of(changes))
        rows = None
        if deleted is not None:
            touched |= set(self.buckets_of(deleted))
            same = [F.col(f"old.{key}").eqNullSafe(F.col(f"gone.{key}")) for key in keys]
            rows = self.read(sorted(touched)).alias("old").join(deleted.select(*keys).distinct().alias("gone"), same, "left_anti")
        touched = sorted(touched)
        if touched:
            self.replace(upsert_by_key(self.read(touched) if rows is None else rows, changes, keys), touched)
        return touched
