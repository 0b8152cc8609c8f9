"""Exact duplicates through a cuckoo-filter index of live digests.

The index is a stored table, one row per live digest, dealt to shards by digest. A shard is a cuckoo
filter whose buckets also hold what their marks stand for: the whole digest and its owner. A mark that
matches is only a hit; the digest in the bucket decides. Digests are inserted and deleted; a
shard that overflows gets twice the buckets and is filled again from its stored digests.

Rows meet the index in two steps, so a text that a third of all rows share is no hot key: every task first
indexes blocks of its own rows, and only one row per block and digest goes on to the shards.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored
from ledgerspark.llm.manifest import lowered

SLOTS = 4  # of a bucket
KICKS = 200  # moves of an insertion before the filter counts as full
BLOCK = 1 << 17  # rows of a task that are indexed together
SHARD = 1 << 14  # mean digests of a shard

_ROW = "doc_id long, row_no long, digest binary, lead long, size long"
_INDEX = "shard long, buckets long, place long, mark int, digest binary, doc_id long, row_no long, group_size long"


class CuckooIndex:
    """Digests in buckets of four, each in one of two buckets that its mark links; ``value`` is its owner."""

    def __init__(self, buckets: int = 64):
        self.resize(buckets)

    def resize(self, buckets: int) -> None:
        """Empty places for ``buckets`` (a power of two), then everything that was stored before."""
        old = list(zip(self.digests, self.values)) if hasattr(self, "digests") else []
        self.buckets = buckets
        self.marks = [0] * (buckets * SLOTS)
        self.digests: list = [None] * (buckets * SLOTS)
        self.values: list = [None] * (buckets * SLOTS)
        for digest, value in old:
            if digest is not None:
                self.insert(digest, value)

    def mark(self, digest: bytes) -> int:
        """16 bits of the digest that the filter keeps; 0 stands for an empty place."""
        return (digest[8] << 8 | digest[9]) or 1

    def _first(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "big") & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ mark * 0x9E3779B1 >> 7) & (self.buckets - 1)

    def find(self, digest: bytes) -> int:
        """The place of a live digest, -1 if it is not in the index."""
        mark, first = self.mark(digest), self._first(digest)
        for bucket in (first, self._other(first, mark)):
            for place in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[place] == mark and self.digests[place] == digest:
                    return place
        return -1

    def insert(self, digest: bytes, value) -> None:
        """Add a digest that is not live yet."""
        mark, bucket = self.mark(digest), self._first(digest)
        for kick in range(KICKS):
            other = self._other(bucket, mark)
            for place in (*range(bucket * SLOTS, bucket * SLOTS + SLOTS), *range(other * SLOTS, other * SLOTS + SLOTS)):
                if not self.marks[place]:
                    self.marks[place], self.digests[place], self.values[place] = mark, digest, value
                    return
            # The digest takes a place of its other bucket; who was there moves on to its own other one.
            place = other * SLOTS + kick % SLOTS
            self.marks[place], mark = mark, self.marks[place]
            self.digests[place], digest = digest, self.digests[place]
            self.values[place], value = value, self.values[place]
            bucket = other
        self.resize(2 * self.buckets)
        self.insert(digest, value)

    def delete(self, digest: bytes) -> bool:
        """Take a live digest out; False if it is not in the index."""
        place = self.find(digest)
        if place >= 0:
            self.marks[place], self.digests[place], self.values[place] = 0, None, None
        return place >= 0

    def add(self, digest: bytes, owner: tuple, size: int) -> list:
        """Count ``size`` rows under the digest; a larger owner takes the place of the live one.

        Returns the live [owner, size], which later calls keep up to date.
        """
        place = self.find(digest)
        if place < 0:
            group = [owner, size]
            self.insert(digest, group)
            return group
        group = self.values[place]
        group[1] += size
        if owner > group[0]:
            self.delete(digest)
            group[0] = owner
            self.insert(digest, group)
        return group


def _owner(doc_id, row_no: int) -> tuple:
    """The largest doc_id owns a group, ties go to the later row; a null id comes before all others."""
    return doc_id is not None, doc_id or 0, row_no


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to each row the ``lead`` of its digest in its block, and to leads the ``size`` of the group there."""
    names = [f.split()[0] for f in _ROW.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def ended(rows: list, groups: list) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(rows), 10_000):
            out = [(doc_id, row_no, digest, group[0][2], group[1] if group[0][2] == row_no else 0) for (doc_id, row_no, digest), group
                   in zip(rows[start:start + 10_000], groups[start:start + 10_000])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    index, rows, groups = CuckooIndex(), [], []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names[:3])):
            rows.append(row)
            groups.append(index.add(row[2], _owner(row[0], row[1]), 1))
        if len(rows) >= BLOCK:
            yield from ended(rows, groups)
            index, rows, groups = CuckooIndex(), [], []
    yield from ended(rows, groups)


def digested(docs: DataFrame) -> DataFrame:
    """Stored rows doc_id, row_no, digest, lead, size of every document.

    The digest is the SHA-256 of the text in UTF-8 after lower-casing A-Z, null counting as empty.
    ``lead`` is the row_no that owns the digest among the rows of one block; it alone has a ``size``.
    """
    text = lowered(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"),
                       F.unhex(F.sha2(text, 256)).alias("digest"))
    return stored(rows.mapInArrow(_in_blocks, _ROW))


def _changed(live: pa.Table, events: pa.Table) -> pa.Table:
    """The rows of one shard after its deletions and then its insertions."""
    shard = (live if live.num_rows else events).column("shard")[0].as_py()
    index = CuckooIndex(live.column("buckets")[0].as_py() if live.num_rows else 64)
    for place, mark, digest, doc_id, row_no, size in zip(*(live.column(c).to_pylist() for c in (
            "place", "mark", "digest", "doc_id", "row_no", "group_size"))):
        index.marks[place], index.digests[place] = mark, digest
        index.values[place] = [_owner(doc_id, row_no), size]
    rows = list(zip(*(events.column(c).to_pylist() for c in ("digest", "doc_id", "row_no", "size"))))
    for digest, _, _, size in rows:
        if size is None:
            index.delete(digest)
    for digest, doc_id, row_no, size in rows:
        if size is not None:
            index.add(digest, _owner(doc_id, row_no), size)
    places = [p for p, mark in enumerate(index.marks) if mark]
    owners = [index.values[p][0] for p in places]
    return pa.table({
        "shard": pa.array([shard] * len(places), pa.int64()), "buckets": pa.array([index.buckets] * len(places), pa.int64()),
        "place": pa.array(places, pa.int64()), "mark": pa.array([index.marks[p] for p in places], pa.int32()),
        "digest": pa.array([index.digests[p] for p in places], pa.binary()),
        "doc_id": pa.array([o[1] if o[0] else None for o in owners], pa.int64()), "row_no": pa.array([o[2] for o in owners], pa.int64()),
        "group_size": pa.array([index.values[p][1] for p in places], pa.int64())})


@dataclass
class Index:
    """Live digests with the row that owns each (doc_id, row_no) and the rows counted under it, by shard and place."""

    rows: DataFrame
    shards: int

    @staticmethod
    def empty(spark: SparkSession, digests: int) -> "Index":
        """An index with shards for about so many digests; more digests make larger shards."""
        return Index(spark.createDataFrame([], _INDEX), max(1, -(-digests // SHARD)))

    def _after(self, events: DataFrame) -> "Index":
        shard = F.pmod(F.xxhash64("digest"), F.lit(self.shards)).alias("shard")
        dealt = events.select(shard, "digest", "doc_id", "row_no", "size")
        return Index(stored(self.rows.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(_changed, _INDEX)), self.shards)

    def insert(self, rows: DataFrame) -> "Index":
        """The index with the rows of ``digested`` added; only their leads travel.

        Equal digests become one entry: the largest doc_id owns it, sizes add up. Repeating rows that were
        inserted before counts them again; ``row_no`` only breaks ties.
        """
        return self._after(rows.where("size > 0"))

    def delete(self, rows: DataFrame) -> "Index":
        """The index without the digests of these rows; digests that are not live do not matter."""
        gone = rows.where("size > 0").withColumn("size", F.lit(None).cast("long"))
        return self._after(gone)

    def matches(self, rows: DataFrame) -> DataFrame:
        """Every row of ``digested`` with the owner of its digest: doc_id, row_no, digest, keep_id, keep_row, group_size.

        All but doc_id, row_no and digest are null where the digest is not live. Leads meet the index by digest,
        all other rows their lead, so no key has more rows than a block or than there are blocks.
        """
        owners = self.rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("row_no").alias("keep_row"), "group_size")
        leads = rows.where("size > 0").select("lead", "digest").join(owners, "digest", "left").drop("digest")
        return rows.select("doc_id", "row_no", "digest", "lead").join(leads, "lead").drop("lead")


def dedup(docs: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after lower-casing A-Z only; null counts as empty. Of equal texts the row
    with the largest doc_id stays, of rows that tie in it exactly one; rows with a null id stay only
    where no other has an id, and then keep_id is null. An empty table has no rows; other columns do not matter.
    """
    rows = digested(docs)
    index = Index.empty(docs.sparkSession, rows.where("size > 0").count()).insert(rows)
    return index.matches(rows).select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
