"""Product codes of vectors, learned and assigned over Hilbert-sorted flat blocks.

A vector is cut into equal parts; every part position has a codebook, and a vector's code names the
nearest entry of each. All arithmetic is on integers, so codes do not depend on how rows are spread.

Parts are sorted along a Hilbert curve and packed into blocks of neighbours. A block keeps the box around its
parts and their sum. The distances of a round's entries to the box leave a shortlist: an entry whose least
distance is above the smallest greatest distance of any entry is nearest to none of the parts.
A block with one entry left adds its sum without a look at its parts; a small kernel
compares the parts of the others with the shortlist alone.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored

BLOCK = 256  # parts of a block
BITS = 4  # of a component on the curve
# Components beyond this after scaling are set to it: sums of squares then fit 64 bits up to 64 per part.
LIMIT = (1 << 27) - 1

_PART = "part int, curve binary, row_no long, x binary"
_BLOCK = "part int, row_nos binary, low binary, high binary, total binary, x binary"


def hilbert_keys(points: np.ndarray, bits: int) -> list[bytes]:
    """Places of ``points`` (n, d), components below 2**bits, on the Hilbert curve through their cube, as sortable bytes.

    Skilling's transform (2004), for all points at once: turn the cube back bit by bit, then Gray-decode.
    """
    x = points.astype(np.int64).T.copy()
    bit = 1 << (bits - 1)
    while bit > 1:
        lower = bit - 1
        for axis in x:
            turned = (axis & bit) > 0
            swapped = np.where(turned, 0, (x[0] ^ axis) & lower)
            x[0] ^= np.where(turned, lower, swapped)
            axis ^= swapped
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flips, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flips ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flips
    planes = np.concatenate([(x >> b) & 1 for b in range(bits - 1, -1, -1)])
    return [row.tobytes() for row in np.packbits(planes.astype(np.uint8).T, axis=1)]


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Indexes, ascending, of the entries (k, d) that can be nearest, or tie for it, to a point in the box."""
    outside = np.maximum(np.maximum(low - entries, entries - high), 0)
    across = np.maximum(np.abs(entries - low), np.abs(entries - high))
    return np.flatnonzero((outside * outside).sum(axis=1) <= (across * across).sum(axis=1).min())


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower one) and the squared distance, for each row of ``x``.

    Products of small integers are exact in floating point, and much faster there; larger ones stay integers.
    """
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    distances = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(x)), best].astype(np.int64)


def kept_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """Stored rows row_no, vec_id, label, x of the vectors without null or non-finite components.

    ``x`` holds floor(scale * component), kept within ±(2**27 - 1).
    """
    broken = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(
        c.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return stored(vectors.where(F.col("embedding").isNotNull() & ~broken)
                  .select(F.monotonically_increasing_id().alias("row_no"), "vec_id", "label", scaled.alias("x")))


def _matrix(rows, width: int) -> np.ndarray:
    """Vectors as one matrix; a shorter one is filled up with zeros."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _blocks(kept: DataFrame, parts: int, width: int, low: int, high: int) -> DataFrame:
    """Stored blocks: the parts of all vectors, neighbours on the curve together.

    Parts are range-sorted by position, curve and row, so very many equal parts are still many ranges.
    """
    size = width // parts

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["x"], width)
            for part in range(parts):
                mine = x[:, part * size:(part + 1) * size]
                yield pd.DataFrame({"part": part, "curve": hilbert_keys(((mine - low) << BITS) // (high - low + 1), BITS),
                                    "row_no": batch["row_no"], "x": [r.tobytes() for r in mine.astype(np.int32)]})

    def block(rows: pd.DataFrame) -> dict:
        x = np.frombuffer(b"".join(rows["x"]), np.int32).reshape(-1, size).astype(np.int64)
        return {"part": rows["part"].iat[0], "row_nos": rows["row_no"].to_numpy(np.int64).tobytes(), "low": x.min(axis=0).tobytes(),
                "high": x.max(axis=0).tobytes(), "total": x.sum(axis=0).tobytes(), "x": x.astype(np.int32).tobytes()}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch])
            rest, full = None, []
            for _, group in rows.groupby("part", sort=True):
                if rest is not None and len(rest):  # rows come sorted by part: the one before has ended
                    full.append(block(rest))
                n = len(group) // BLOCK * BLOCK
                full += [block(group.iloc[i:i + BLOCK]) for i in range(0, n, BLOCK)]
                rest = group.iloc[n:]
            if full:
                yield pd.DataFrame(full)
        if rest is not None and len(rest):
            yield pd.DataFrame([block(rest)])

    order = ["part", "curve", "row_no"]
    sorted_ = kept.select("row_no", "x").mapInPandas(cut, _PART).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(sorted_.mapInPandas(pack, _BLOCK))


def _read(row, size: int) -> tuple[np.ndarray, ...]:
    low, high, total = (np.frombuffer(b, np.int64) for b in (row.low, row.high, row.total))
    return low, high, total, np.frombuffer(row.x, np.int32).reshape(-1, size).astype(np.int64)


def _sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, place, n, total): number of parts that each entry is nearest to and the sums of their components.

    A task adds up all its blocks first; ``place`` -1 carries the number.
    """
    parts, entries, size = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((parts, entries, size + 1), dtype=np.int64)
        for batch in batches:
            for row in batch.itertuples(index=False):
                low, high, total, x = _read(row, size)
                able = shortlist(low, high, books[row.part])
                mine = sums[row.part]
                if len(able) == 1:
                    mine[able[0]] += np.append(total, len(x))
                else:
                    np.add.at(mine, able[nearest(x, books[row.part][able])[0]], np.hstack([x, np.ones((len(x), 1), np.int64)]))
        part, entry, place = np.nonzero((sums != 0) | (sums[:, :, -1:] > 0))
        yield pd.DataFrame({"part": part, "entry": entry, "place": place, "total": sums[part, entry, place]})

    return (blocks.mapInPandas(run, "part int, entry int, place int, total long")
            .groupBy("part", "entry", "place").agg(F.sum("total").alias("total")))


def learn(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, size) after so many rounds of assigning all parts and moving every
    used entry to the componentwise floor of their mean. Only sums per entry come to the driver."""
    for _ in range(rounds):
        sums = np.zeros((*books.shape[:2], books.shape[2] + 1), dtype=np.int64)
        for r in _sums(blocks, books).collect():
            sums[r["part"], r["entry"], r["place"]] = r["total"]
        n = sums[:, :, -1:]
        books = np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), books)
    return books


def assign(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(row_no, codes, error) per vector: the nearest entry of each part, and the squared distances added up."""
    parts, _, size = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                low, high, _, x = _read(row, size)
                able = shortlist(low, high, books[row.part])
                best, distance = nearest(x, books[row.part][able])
                yield pd.DataFrame({"row_no": np.frombuffer(row.row_nos, np.int64), "part": row.part,
                                    "code": able[best], "distance": distance})

    coded = blocks.mapInPandas(run, "row_no long, part int, code int, distance long").groupBy("row_no").agg(
        *[F.max(F.when(F.col("part") == p, F.col("code"))).alias(f"code_{p}") for p in range(parts)],
        F.sum("distance").alias("error"))
    return coded.select("row_no", F.array(*[f"code_{p}" for p in range(parts)]).alias("codes"), "error")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """Stored rows vec_id, label, codes, error of all usable vectors, and the codebooks (parts, entries, size).

    Rows whose vector is null or holds null or non-finite components are left out. The codebooks start
    as the parts of the ``entries`` smallest vec_ids (null ids last, ties by vector, label and row); with fewer
    rows there are fewer entries. Vectors shorter than the longest one, or than a multiple of ``parts``, count
    as filled up with zeros. Repeated rows are coded each; an empty table gives no rows and empty books.
    """
    kept = kept_vectors(vectors, scale)
    longest, low, high = kept.agg(F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    width = max(1, -(-(longest or 0) // parts)) * parts
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x", F.col("label").asc_nulls_last(), "row_no").limit(entries).select("x").collect()
    books = _matrix([r["x"] for r in seeds], width).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2)
    # Zeros that fill up a vector are on the curve too.
    blocks = _blocks(kept, parts, width, min(low or 0, 0), max(high or 0, 0))
    books = learn(blocks, books, rounds)
    return stored(kept.select("row_no", "vec_id", "label").join(assign(blocks, books), "row_no").drop("row_no")), books


def codebooks_sha256(books: np.ndarray) -> str:
    """Hash of all entries' decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error (summed over equal labels, nulls
    together) and codebooks_sha256 of every usable vector."""
    coded, books = compress(vectors)
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
