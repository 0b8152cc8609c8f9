"""SimHash near-duplicates through a Gray-ordered hierarchical index."""

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import components, stored

SLICE = 2_048  # rows of a node that is searched as one
LEAF = 64
# Rows of the search: links, or else nodes of the index.
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("t", pa.int32()), ("block", pa.int64()), ("node", pa.string()),
                   ("ones", pa.int64()), ("zeros", pa.int64()), ("fps", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32()))])


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of the word shingles of one text, as a signed 64-bit number."""
    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, 42)]
    else:
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1:], strict=False)]
    # Bits of a text of any length are counted block by block.
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = np.array(hashes[i:i + 65_536], np.uint64)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Add ``_fp`` to ``docs``; null text has fingerprint 0."""
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn("_fp", run(F.coalesce(F.col("text"), F.lit(""))))


def _gray_rank(x: Column) -> Column:
    """Position of 64 bits in Gray order, shifted so that signed numbers sort by it."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x.bitwiseXOR(F.lit(-(2 ** 63)))


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Edges ``a``, ``b`` that connect all distinct fingerprints ``_fp`` within ``distance`` bits.

    Two such fingerprints agree in one of ``distance + 1`` blocks of bits. For every block the
    fingerprints, turned so that the block comes first, are range-sorted by Gray rank; equal
    blocks lie side by side, and so do equal further bits. Slices of a block's rows are upper
    nodes that carry the bits all their rows share; a pair of nodes whose shared bits differ
    in more than ``distance`` places is dropped whole. Not all pairs come out, but
    edges enough to keep every connection.
    """
    tables = distance + 1
    if 64 % tables:
        raise ValueError("distance + 1 must divide 64")
    width = 64 // tables
    turned = prints.withColumn("_t", F.explode(F.array(*map(F.lit, range(tables)))))
    spin = F.expr(f"shiftleft(_fp, _t * {width}) | shiftrightunsigned(_fp, (64 - _t * {width}) % 64)")
    spin = F.when(F.col("_t") == 0, F.col("_fp")).otherwise(spin)
    ranked = (turned.withColumn("_rank", _gray_rank(spin))
              .repartitionByRange("_t", "_rank").sortWithinPartitions("_t", "_rank").select("_t", "_rank", "_fp"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _search((b.to_pandas() for b in batches), distance, width):
            yield pa.RecordBatch.from_arrays([
                pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(len(rows), f.type) for f in FOUND], schema=FOUND)

    found = stored(ranked.mapInArrow(search, "a long, b long, t int, block long, node string, ones long, zeros long, fps array<long>, parts array<int>"))
    nodes = found.where("node is not null")
    return found.where("a is not null").select("a", "b").union(_across(nodes, distance))


def _across(nodes: DataFrame, distance: int) -> DataFrame:
    """Edges between different nodes of the same block."""
    heads = nodes.select("t", "block", "node", "ones", "zeros")
    # A block of very many nodes is dealt over several tasks.
    salts = 8
    left = heads.select("t", "block", F.col("node").alias("x"), F.col("ones").alias("_o"), F.col("zeros").alias("_z"),
                        F.pmod(F.xxhash64("node"), F.lit(salts)).alias("_s"))
    right = heads.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    apart = F.expr("bit_count((_o & zeros) | (_z & ones))")
    pairs = (left.join(right, ["t", "block", "_s"]).where((F.col("x") < F.col("node")) & (apart <= distance))
             .select("x", F.col("node").alias("y")))
    rows = nodes.select("node", F.struct("fps", "parts").alias("rows"))
    both = (pairs.join(rows.select(F.col("node").alias("x"), F.col("rows").alias("p")), "x")
            .join(rows.select(F.col("node").alias("y"), F.col("rows").alias("q")), "y")
            .select("p.fps", "p.parts", F.col("q.fps").alias("fps2"), F.col("q.parts").alias("parts2")))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, a, q, b in batch.itertuples(index=False):
                fp = np.concatenate([p, q]).astype(np.int64).view(np.uint64)
                tree = _Group(fp, distance, np.concatenate([a, np.asarray(b) + len(p)]).astype(np.int32))
                tree.pair(0, len(p), len(p), len(p) + len(q))
                yield tree.frame()

    return both.mapInPandas(search, "a long, b long")


def _search(batches: Iterator[pd.DataFrame], distance: int, width: int) -> Iterator[pd.DataFrame]:
    """Edges within the nodes of one partition, and the nodes of blocks that may go on elsewhere."""
    name, n = uuid.uuid4().hex, 0
    rest = pd.DataFrame({"_t": [], "_rank": [], "_fp": []}, dtype="int64")
    ended = False
    batches = iter(batches)
    while not ended:
        batch = next(batches, None)
        ended = batch is None
        rows = rest if ended else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        block = (rows["_rank"].to_numpy().view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)
        t, fp = rows["_t"].to_numpy(), rows["_fp"].to_numpy().view(np.uint64)
        cut = np.flatnonzero((block[1:] != block[:-1]) | (t[1:] != t[:-1])) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(rows)]
        last = int(starts[-1])
        # A group that may go on is kept back until it fills a slice.
        if not ended and len(rows) - last < SLICE:
            starts, ends = starts[:-1], ends[:-1]
            rest = rows.iloc[last:]
        else:
            rest = rows.iloc[:0]
        near = _neighbours(fp, starts, ends, distance)
        if len(near):
            yield near
        edge = ends - starts > SLICE
        edge[:1] = edge[-1:] = True
        for k in np.flatnonzero((ends - starts > 8) | edge):
            s, e = int(starts[k]), int(ends[k])
            for i in range(s, e, SLICE):
                tree = _Group(fp[i:min(i + SLICE, e)], distance)
                tree.within(0, len(tree.fp))
                if tree.edges:
                    yield tree.frame()
                # The first and last block may go on in other partitions or batches, a long one in other slices.
                if edge[k]:
                    n += 1
                    ones, zeros = tree.shared(0, len(tree.fp))
                    yield pd.DataFrame({
                        "t": [int(t[s])], "block": [int(block[s])], "node": [f"{name}-{n:09d}"],
                        "ones": [int(ones.view(np.int64))], "zeros": [int(zeros.view(np.int64))],
                        "fps": [tree.fp.view(np.int64)], "parts": [tree.part]})


def _neighbours(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, distance: int) -> pd.DataFrame:
    """All links within groups of up to eight rows, compared row by row at once."""
    size = ends - starts
    group = np.repeat(np.where(size <= 8, np.arange(len(size)), -1), size)
    fp = fp[int(starts[0]):int(ends[-1])] if len(starts) else fp[:0]
    a, b = [], []
    for d in range(1, min(8, len(fp))):
        same = (group[:-d] == group[d:]) & (group[d:] >= 0)
        at = np.flatnonzero(same & (np.bitwise_count(fp[:-d] ^ fp[d:]) <= distance))
        a.append(fp[at].view(np.int64))
        b.append(fp[at + d].view(np.int64))
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}) if a else pd.DataFrame({"a": [], "b": []})


class _Group:
    """Gray-ordered rows under a tree of halves; finds edges that connect all rows within reach."""

    def __init__(self, fp: np.ndarray, distance: int, part: np.ndarray | None = None):
        self.fp, self.distance = fp, distance
        self.part = np.arange(len(fp), dtype=np.int32) if part is None else part
        self.edges: list[tuple[int, int]] = []
        self.masks: dict[tuple[int, int], tuple] = {}

    def frame(self) -> pd.DataFrame:
        at = np.array(self.edges, dtype=np.int64).reshape(-1, 2)
        fp = self.fp.view(np.int64)
        return pd.DataFrame({"a": fp[at[:, 0]], "b": fp[at[:, 1]]})

    def shared(self, s: int, e: int) -> tuple:
        """Bits that are one, and bits that are zero, in all rows of a node."""
        if (s, e) not in self.masks:
            rows = self.fp[s:e]
            self.masks[s, e] = np.bitwise_and.reduce(rows), np.bitwise_and.reduce(~rows)
        return self.masks[s, e]

    def within(self, s: int, e: int) -> None:
        if e - s <= LEAF:
            self._match(s, e, s, e)
            return
        m = (s + e) // 2
        self.within(s, m)
        self.within(m, e)
        self.pair(s, m, m, e)

    def pair(self, a: int, b: int, c: int, d: int) -> None:
        ones, zeros = self.shared(a, b)
        others, blanks = self.shared(c, d)
        if np.bitwise_count((ones & blanks) | (zeros & others)) > self.distance:
            return
        left, right = self.part[a:b], self.part[c:d]
        if left[0] == right[0] and (left == left[0]).all() and (right == left[0]).all():
            return
        if b - a <= LEAF and d - c <= LEAF:
            self._match(a, b, c, d)
        elif b - a >= d - c:
            m = (a + b) // 2
            self.pair(a, m, c, d)
            self.pair(m, b, c, d)
        else:
            m = (c + d) // 2
            self.pair(a, b, c, m)
            self.pair(a, b, m, d)

    def _match(self, a: int, b: int, c: int, d: int) -> None:
        near = np.bitwise_count(self.fp[a:b, None] ^ self.fp[None, c:d]) <= self.distance
        while True:
            new = near & (self.part[a:b, None] != self.part[None, c:d])
            at = int(new.argmax())
            i, j = divmod(at, d - c)
            if not new[i, j]:
                return
            i, j = a + i, c + j
            self.edges.append((i, j))
            self.part[self.part == self.part[j]] = self.part[i]


def link(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """Rows ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for all rows of ``docs``.

    Documents whose fingerprints differ in at most ``distance`` bits are linked;
    ``component_id`` is the smallest doc_id that can be reached, null if none of them has an id.
    Equal fingerprints are searched once. Null and empty texts have fingerprint zero.
    """
    slim = stored(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "_fp"))
    named = _components(slim, distance)
    return (slim.join(named, "_fp")
            .select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"))


def _components(slim: DataFrame, distance: int) -> DataFrame:
    """Each distinct fingerprint ``_fp`` with the smallest doc_id of its component."""
    prints = slim.groupBy("_fp").agg(F.min("doc_id").alias("_first"))
    roots = components(links(prints.select("_fp"), distance))
    named = (prints.join(roots, prints["_fp"] == roots["node"], "left")
             .select("_fp", "_first", F.coalesce("root", "_fp").alias("_root")))
    firsts = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return named.join(firsts, "_root").select("_fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component stays.

    It is the row with the smallest doc_id, null last; of several such rows the one with the
    smallest hash over all columns, of equal rows any one. Columns and types stay.
    """
    row = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns))
    marked = docs.withColumn("_row", row)
    slim = stored(fingerprints(marked.select("doc_id", "text", "_row"), shingle).select("doc_id", "_fp", "_row"))
    prints = slim.groupBy("_fp").agg(F.min("doc_id").alias("_first"))
    roots = components(links(prints.select("_fp"), distance))
    named = prints.join(roots, prints["_fp"] == roots["node"], "left").select("_fp", F.coalesce("root", "_fp").alias("_root"))
    # One row per distinct document first, so that many equal rows are counted where they lie.
    kinds = slim.groupBy("_fp", "doc_id", "_row").agg(F.count("*").alias("_n"))
    best = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_row").alias("c"), F.col("_n").alias("n"))
    ahead = kinds.groupBy("_fp").agg(F.min(best).alias("k"))
    stay = (ahead.join(named, "_fp").groupBy("_root").agg(F.min("k").alias("k"))
            .select(F.col("k.b").alias("_id"), F.col("k.c").alias("_row"), F.col("k.n").alias("_n")))
    kept = marked.join(stay, (marked["_row"] == stay["_row"]) & marked["doc_id"].eqNullSafe(stay["_id"])).drop(stay["_row"]).drop("_id")
    once = kept.where("_n = 1").drop("_row", "_n")
    return once.union(kept.where("_n > 1").dropDuplicates(["doc_id", "_row"]).drop("_row", "_n"))
