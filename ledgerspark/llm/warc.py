"""Merkle fixity audit of WARC replicas, with DataFrame functions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import prefix_sums, stored

FANOUT = 16
LEVELS = ("range", "span", "stretch", "file", "shelf", "root")


def records(pages: DataFrame, files: int, ids: tuple[str, ...] = ("page_id", "url"), payload: str = "html") -> DataFrame:
    """WARC response records: ``file_no``, ``digest``, ``length``, ``copies`` and the id columns.

    A record's bytes are its header, the payload and two line ends; the digest is their SHA-256. Equal
    records of a file are one row with their number. A null payload or id is written as empty, yet
    a null id differs from an empty one. The file is a hash of the ids, so a replica with changed or
    missing payloads deals its records alike.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(F.col(ids[-1]).cast("string"), F.lit("")),
                    F.lit("\r\nWARC-Record-ID: "), F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ids)),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    whole = F.concat(head, body, F.lit("\r\n\r\n"))
    return (pages.select(*ids, F.pmod(F.xxhash64(*ids), F.lit(files)).alias("file_no"),
                         F.sha2(whole, 256).alias("digest"), F.octet_length(whole).cast("long").alias("length"))
            .groupBy("file_no", *ids, "digest", "length").agg(F.count("*").alias("copies")))


def layout(rows: DataFrame, ids: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Add ``offset``: where the first copy of each record starts in its file, in order of ids and digest.

    Offsets are distributed prefix sums, so one file may hold most of the records.
    """
    sized = rows.withColumn("_bytes", F.col("length") * F.col("copies"))
    return prefix_sums(sized, "file_no", [*ids, "digest"], "_bytes", "offset").drop("_bytes")


def tree(rows: DataFrame, range_bytes: int) -> dict[str, DataFrame]:
    """Hashes of all nodes by level, each with ``node``, its ``parent`` and ``hash``.

    A leaf covers the records that start in one range of offsets of a file; 16 ranges make a span, 16
    spans a stretch, all stretches a file, 256 files a shelf, all shelves the root. A node's hash is the
    SHA-256 of its children's hashes in order. A range holds no more records than headers fit in it.
    """
    at = F.floor(F.col("offset") / range_bytes).cast("long")
    line = F.struct("offset", "digest", "copies")
    leaves = rows.groupBy("file_no", at.alias("n")).agg(F.sort_array(F.collect_list(line)).alias("_c"))
    text = F.array_join(F.transform("_c", lambda c: F.concat_ws(":", c["offset"], c["digest"], c["copies"])), "\n")
    out, n = {}, F.col("n")
    level = stored(leaves.select("file_no", "n", F.sha2(text, 256).alias("hash")))
    for name in LEVELS:
        if name in ("range", "span", "stretch"):
            node = F.struct("file_no", n.alias("n"))
            up = F.struct("file_no", (F.floor(n / FANOUT).cast("long") if name != "stretch" else F.lit(0).cast("long")).alias("n"))
        elif name == "file":
            node, up = F.struct("file_no", n.alias("n")), F.struct(F.floor(F.col("file_no") / 256).cast("long").alias("file_no"), F.lit(0).cast("long").alias("n"))
        else:
            node, up = F.struct("file_no", n.alias("n")), F.struct(F.lit(0).cast("long").alias("file_no"), F.lit(0).cast("long").alias("n"))
        out[name] = level.select(node.alias("node"), up.alias("parent"), "hash")
        kids = out[name].groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("_c"))
        joined = F.array_join(F.transform("_c", lambda c: F.concat_ws(":", c["node"]["file_no"], c["node"]["n"], c["hash"])), "\n")
        level = stored(kids.select(F.col("parent.file_no").alias("file_no"), F.col("parent.n").alias("n"), F.sha2(joined, 256).alias("hash")))
    return out


def audit(ours: DataFrame, theirs: DataFrame, ids: tuple[str, ...] = ("page_id", "url"), payload: str = "html",
          file_bytes: int = 64 << 20, range_bytes: int = 64 << 10) -> DataFrame:
    """Records of ``theirs`` that are not as in ``ours``: id columns, ``kind``, ``file_no``, ``offset``, ``copies``.

    Kind is ``changed`` (the id is there with other bytes), ``missing``, ``extra`` (an unknown id) or
    ``copies`` (another number of equal records). ``offset`` is the place in our file, in theirs for
    extra records; ``copies`` counts the records concerned. Only branches whose hashes differ
    are followed down; equal records that merely moved are no finding. Equal replicas and empty tables give
    no rows; nulls in ids are values of their own.
    """
    total = ours.agg(F.sum(F.octet_length(payload))).first()[0] or 0
    files = max(1, total // file_bytes)
    sides = [stored(layout(records(t, files, ids, payload), ids)) for t in (ours, theirs)]
    trees = [tree(s, range_bytes) for s in sides]
    bad = None
    for name in reversed(LEVELS):
        a, b = (t[name].select("node", "parent", F.col("hash").alias(h)) for t, h in zip(trees, ("x", "y"), strict=True))
        if bad is not None:
            a, b = (t.join(bad, t["parent"] == bad["bad"], "left_semi") for t in (a, b))
        both = a.drop("parent").join(b.drop("parent"), "node", "full")
        bad = stored(both.where(~F.col("x").eqNullSafe(F.col("y"))).select(F.col("node").alias("bad")))
    ranges = bad.select(F.col("bad.file_no").alias("file_no"), F.col("bad.n").alias("_n"))
    at = F.floor(F.col("offset") / range_bytes).cast("long")
    ours_left, theirs_left = (
        s.withColumn("_n", at).join(ranges, ["file_no", "_n"], "left_semi").drop("_n", "length") for s in sides)
    # A record may have moved into another range: records stand side by side by id and digest.
    key = F.struct(*(F.col(c) for c in ids))
    lines = ours_left.select(key.alias("id"), "digest", "file_no", "offset", "copies", F.lit(0).alias("side")).union(
        theirs_left.select(key.alias("id"), "digest", "file_no", "offset", "copies", F.lit(1).alias("side")))
    first = lambda side, col: F.max(F.when(F.col("side") == side, F.col(col)))
    versions = lines.groupBy("id", "file_no", "digest").agg(
        F.coalesce(first(0, "copies"), F.lit(0)).alias("a"), F.coalesce(first(1, "copies"), F.lit(0)).alias("b"),
        first(0, "offset").alias("oa"), first(1, "offset").alias("ob"))
    differ = versions.where("a <> b")
    found = differ.groupBy("id", "file_no").agg(
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("gone"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("new"),
        F.min("oa").alias("oa"), F.min("ob").alias("ob"), F.min(F.least("a", "b")).alias("common"))
    kind = (F.when(F.col("common") > 0, "copies").when((F.col("gone") > 0) & (F.col("new") > 0), "changed")
            .when(F.col("gone") > 0, "missing").otherwise("extra"))
    return found.select("id.*", kind.alias("kind"), "file_no", F.coalesce("oa", "ob").alias("offset"), F.greatest("gone", "new").alias("copies"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with planted damage, chosen by page_id: records lost, doubled, altered or cut short."""
    spot = F.col("page_id") % 1009
    html = F.when(spot == 17, F.overlay("html", F.lit("?"), F.lit(1))).when(spot == 23, F.substring("html", 1, 200)).otherwise(F.col("html"))
    times = F.when(spot == 31, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return pages.where(F.coalesce(spot != 7, F.lit(True))).withColumn("html", html).withColumn("_x", F.explode(times)).drop("_x")
