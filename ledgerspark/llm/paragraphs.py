"""Substring dedup: paragraphs that repeat, exactly or nearly, and passages inside them that repeat word for word."""

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import components, stored

WORDS = re.compile(r"\w+")
SHINGLE = 5
PIECE = 25  # words of a passage's pieces
RUN = 50  # words of a repeated run that holds one chosen piece at least
CHUNK = 256  # paragraphs of a bucket compared by one task at a time
POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

_MARKS = ("doc_id string, text_key long, para_no array<int>, n_lines array<int>, n_words array<int>, key array<long>, "
          "new_keys array<long>, bands array<long>, seeds array<long>")
_SEEN = "key long, shingles array<long>, seed long, doc_id string, text_key long, para_no int, _last int, word_no int"
_SEEN_NAMES = [f.split()[0] for f in _SEEN.split(", ")]


def tune(threshold: float = 0.8, recall: float = 0.995, rows: int = 4) -> int:
    """Bands of ``rows`` minima for which a pair at ``threshold`` collides with at least ``recall``."""
    bands = 1
    while 1 - (1 - threshold ** rows) ** bands < recall:
        bands += 1
    return bands


class WordHashes(dict):
    """Hashes of words in lower case, remembered by the words as they stand."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower())
        return value

    def lines(self, text: str) -> list[list[int]]:
        """The hashes of the words of every line."""
        return [[*map(self.__getitem__, WORDS.findall(line))] for line in text.split("\n")]


def shingle_hashes(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of all texts (hashes of words), where each text's begin, and its number of words.

    A text of fewer words has one shingle, its whole sequence.
    """
    every, sizes, counts = [], [], []
    for found in texts:
        counts.append(len(found))
        # Short texts are filled up, so that they have one shingle that tells the length too.
        short = SHINGLE - len(found)
        every += found
        if short > 0:
            every += [short] * short
        sizes.append(max(SHINGLE, len(found)))
    w = np.array(every, np.uint64)
    n = len(w) - SHINGLE + 1
    mixed = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE):
        mixed += (w[k:k + n] ^ (w[k:k + n] >> np.uint64(29))) * POWERS[k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * POWERS[0]
    mixed ^= mixed >> np.uint64(29)
    ends = np.cumsum(sizes)
    keep = np.ones(len(mixed), bool)
    for k in range(1, SHINGLE):
        keep[ends[:-1] - k] = False
    starts = np.r_[0, np.cumsum(np.array(sizes) - SHINGLE + 1)[:-1]]
    return mixed[keep], starts, np.array(counts)


def bands_of(texts: list[list[int]], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """One hash per text and band, and each text's number of words."""
    hashes, starts, counts = shingle_hashes(texts)
    rng = np.random.default_rng(11)
    a = rng.integers(1, 2 ** 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(texts), bands), np.uint64)
    for band in range(bands):
        total = np.full(len(texts), band + 1, np.uint64)
        for row in range(rows):
            x = hashes * a[band * rows + row]
            x ^= x >> np.uint64(31)
            low = np.minimum.reduceat(x * POWERS[1], starts)
            total = (total ^ low) * POWERS[2]
            total ^= total >> np.uint64(33)
        out[:, band] = total
    return out.view(np.int64), counts


def joined(text: str, min_words: int) -> list[tuple[int, int, int, str]]:
    """The paragraphs of a text: first line, number of lines, words, and the lines themselves.

    Neighbouring lines are taken together until they have ``min_words`` words; what is left over at the end
    joins the paragraph before it. So every word is in one paragraph, and none is shorter unless the text is.
    """
    out, first, part, words = [], None, [], 0
    for no, line in enumerate(text.split("\n")):
        n = len(line.split())
        if n:
            first = no if first is None else first
            part.append(line)
            words += n
            if words >= min_words:
                out.append((first, no - first + 1, words, "\n".join(part)))
                first, part, words = None, [], 0
            last = no
    if part:
        no, _, more, before = out.pop() if out else (first, 0, 0, None)
        out.append((no, last - no + 1, more + words, "\n".join(part if before is None else [before, *part])))
    return out


def find(docs: DataFrame, min_words: int = 1, threshold: float = 0.8, rows: int = 3) -> DataFrame:
    """What repeats: ``doc_id``, ``text_key``, ``para_no``, ``n_lines``, ``word_no``, ``n_words``, ``cluster_id``, ``removed``.

    Rows without ``word_no`` are whole paragraphs, rows with it are pieces of passages that repeat in the
    lines left (``_passages``); ``para_no`` is then the line where the piece begins.

    Paragraphs are lines, neighbours joined until they have ``min_words`` words (``joined``). Those
    without letters or digits are linked to equal ones only, other two when the Jaccard similarity of
    their five-word shingles, in lower case and without marks, reaches ``threshold``; pairs come from
    MinHash bands tuned to find 99.5 % of the pairs at the threshold, and all are verified. Clusters are
    connected components, and all their paragraphs but the first, by doc_id (null last), are
    removed. ``cluster_id`` is the smallest doc_id of the cluster. Equal rows count as one document;
    null texts have no paragraphs. Equal paragraphs are told by a 64-bit hash and compared once.

    Texts are read twice: first for the hashes of paragraphs, their bands and of passages, then, where any
    of those is shared, for the shingles and the places that are needed.
    """
    texts = docs.where("text is not null").select(F.col("doc_id").cast("string"), F.xxhash64("text").alias("text_key"), "text")
    marks = stored(texts.mapInPandas(_marks(min_words, threshold, rows), _MARKS)
                   .withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)))
    every = stored(marks.select("doc_id", "text_key", F.inline(F.arrays_zip("para_no", "n_lines", "n_words", "key"))).distinct())
    signed = marks.select("new_keys", F.posexplode("bands")).select(
        F.col("col").alias("band"), F.get("new_keys", F.floor(F.col("pos") / tune(threshold, rows=rows)).cast("int")).alias("key")).where("band is not null")
    shared = signed.groupBy("band").agg(F.min("key").alias("lead"), F.max("key").alias("_last")).where("lead <> _last").drop("_last")
    members = stored(signed.join(shared, "band").distinct())
    doc = F.xxhash64("doc_id", "text_key")
    seeds = marks.select(doc.alias("doc"), "text_key", F.explode("seeds").alias("seed"))
    passed = stored(seeds.groupBy("seed").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x <> y").select("seed"))
    # One text of each shared paragraph, and all texts with a shared passage, are looked at again.
    owners = every.join(members.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("text_key").alias("text_key"))
    wanted = (owners.groupBy("text_key").agg(F.collect_set("key").alias("keys"))
              .join(seeds.join(passed, "seed", "left_semi").groupBy("text_key").agg(F.collect_set("seed").alias("spots")), "text_key", "full"))
    seen = stored(texts.join(wanted, "text_key").mapInPandas(_look(min_words), _SEEN)
                  .withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)))
    sets = stored(seen.where("key is not null").groupBy("key").agg(F.min("shingles").alias("shingles")))
    whole = stored(_removals(every, _clusters(members, sets, threshold)).withColumn("word_no", F.lit(None).cast("int")))
    columns = ["doc_id", "text_key", "para_no", "n_lines", "word_no", "n_words", "cluster_id", "removed"]
    return whole.select(*columns).unionByName(_passages(seen.where("seed is not null"), whole).select(*columns))


def _marks(min_words: int, threshold: float, rows: int):
    """Per text its paragraphs, the bands of those that the task has not signed yet, and the hashes of its chosen pieces."""
    bands = tune(threshold, rows=rows)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, signed = WordHashes(), set()
        for batch in batches:
            for i in range(0, len(batch), 300):
                part = batch[i:i + 300]
                for known in (words, signed):
                    if len(known) > 1_000_000:
                        known.clear()
                texts, hashed = list(part["text"]), [words.lines(t) for t in part["text"]]
                paras = [joined(t, min_words) for t in texts]
                keys = [[_key(p[3]) for p in ps] for ps in paras]
                new = [(n, k, [*chain.from_iterable(hashed[n][p[0]:p[0] + p[1]])]) for n, (ks, ps) in enumerate(zip(keys, paras))
                       for k, p in zip(ks, ps) if k not in signed and not signed.add(k)]
                new_keys, out = [[] for _ in texts], [[] for _ in texts]
                if new:
                    found, count = bands_of([line for _, _, line in new], bands, rows)
                    # A set that one more shingle takes below the threshold has equal sets alone: one band finds them.
                    size = np.maximum(count - SHINGLE + 1, 1)
                    asked = np.where(count == 0, 0, np.where(size / (size + 1) < threshold - 1e-9, 1, bands))
                    for (n, k, _), row, some in zip(new, found.tolist(), asked.tolist()):
                        new_keys[n].append(k)
                        out[n] += row[:some] + [None] * (bands - some)
                of, _, value, _, _ = chosen(hashed)
                seeds = [np.unique(v) for v in np.split(value, np.searchsorted(of, np.arange(1, len(texts))))]
                yield pd.DataFrame({"doc_id": pd.Series(list(part["doc_id"]), dtype=object), "text_key": part["text_key"].to_numpy(),
                                    **{c: [[p[k] for p in ps] for ps in paras] for k, c in enumerate(("para_no", "n_lines", "n_words"))},
                                    "key": keys, "new_keys": new_keys, "bands": out, "seeds": seeds})

    return mark


def _look(min_words: int):
    """The shingles of wanted paragraphs, each once in a task, and the places of wanted pieces."""
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, done = WordHashes(), set()
        for batch in batches:
            for i in range(0, len(batch), 300):
                part = batch[i:i + 300]
                for known in (words, done):
                    if len(known) > 1_000_000:
                        known.clear()
                hashed, lines = [words.lines(t) for t in part["text"]], {}
                for text, found, keys in zip(part["text"], hashed, part["keys"]):
                    if keys is not None and not done.issuperset(keys):
                        asked = set(keys) - done
                        lines |= {k: [*chain.from_iterable(found[p[0]:p[0] + p[1]])]
                                  for p in joined(text, min_words) if (k := _key(p[3])) in asked}
                done |= lines.keys()
                if lines:
                    hashes, starts, _ = shingle_hashes(list(lines.values()))
                    yield _rows(len(lines), key=list(lines), shingles=[np.unique(x).view(np.int64) for x in np.split(hashes, starts[1:])])
                spots = [set() if x is None else set(x.tolist()) for x in part["spots"]]
                n, at, value, first, last = chosen(hashed)
                keep = np.array([v in spots[k] for k, v in zip(n.tolist(), value.tolist())], dtype=bool)
                if keep.any():
                    n = n[keep]
                    ids = part["doc_id"].to_numpy(dtype=object)[n]
                    yield _rows(len(n), seed=value[keep], doc_id=ids, text_key=part["text_key"].to_numpy()[n],
                                para_no=first[keep], _last=last[keep], word_no=at[keep])

    return look


def _rows(count: int, **columns) -> pd.DataFrame:
    """Rows of the second reading; columns that are not given are null."""
    return pd.DataFrame({c: pd.Series(list(columns.get(c, [None] * count)), dtype=object) for c in _SEEN_NAMES})


def _key(line: str) -> int:
    value = xxhash.xxh3_64_intdigest(line)
    return value - (1 << 64) if value >> 63 else value


def _removals(every: DataFrame, roots: DataFrame) -> DataFrame:
    """The paragraphs of all clusters of two and more; ``removed`` for all but the first of each.

    A cluster is looked at by its different paragraphs, so one that very many texts repeat is one row there.
    """
    at = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_key").alias("c"), F.col("para_no").alias("d"))
    keys = every.groupBy("key").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    rooted = stored(keys.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    clusters = rooted.groupBy("root").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last")).where("not (_first <=> _last)")
    firsts = rooted.select("key", "root").join(clusters.select("root", "_first"), "root").select("key", "_first")
    return (every.withColumn("_at", at).join(firsts, "key")
            .select("doc_id", "text_key", "para_no", "n_lines", "n_words", F.col("_first.b").alias("cluster_id"),
                    (~F.col("_at").eqNullSafe(F.col("_first"))).alias("removed")))


def chosen(texts: list[list[list[int]]]) -> tuple[np.ndarray, ...]:
    """Of texts (hashes of the words of each line) of ``RUN`` words and more the chosen pieces: text, first word, hash, lines of the first and the last word.

    Words are counted over all lines of a text. Of every ``RUN - PIECE + 1`` neighbouring pieces the one with
    the smallest hash is chosen, so a run of ``RUN`` words brings the same piece to every text that holds it.
    """
    span = RUN - PIECE + 1
    every, text_at, sizes, line_at = [], [], [], []
    for n, found in enumerate(texts):
        size = sum(map(len, found))
        if size < RUN:
            continue
        text_at.append((n, len(every)))
        sizes.append(size)
        for no, line in enumerate(found):
            line_at.append((no, len(every)))
            every += line
    if not every:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    w = np.array(every, np.uint64)
    count = len(w) - PIECE + 1
    hashes = np.zeros(count, np.uint64)
    for k in range(PIECE):
        hashes = (hashes ^ (hashes >> np.uint64(29))) * POWERS[1] + w[k:k + count]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * POWERS[2]
    hashes ^= hashes >> np.uint64(29)
    (names, begins), (nos, line_begins) = np.array(text_at).T, np.array(line_at).T
    least = np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(axis=1)
    where = np.arange(len(least))
    # Windows that reach into the next text do not count.
    of = np.searchsorted(begins, where, "right") - 1
    at = np.unique((where + least)[where + RUN <= begins[of] + np.array(sizes)[of]])
    value, of = hashes[at], np.searchsorted(begins, at, "right") - 1
    # Text that repeats itself brings the same piece at short steps: one of PIECE words' length is enough.
    new = np.r_[True, (value[1:] != value[:-1]) | (np.diff(at) > span) | (of[1:] != of[:-1])]
    step = (at - at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]) // PIECE
    keep = new | np.r_[True, step[1:] != step[:-1]]
    at, value, of = at[keep], value[keep], of[keep]
    first, last = (nos[np.searchsorted(line_begins, x, "right") - 1] for x in (at, at + PIECE - 1))
    return names[of], at - begins[of], value.view(np.int64), first, last


def _passages(spots: DataFrame, whole: DataFrame) -> DataFrame:
    """Pieces of ``PIECE`` words that stand in more than one document, outside the removed paragraphs of ``whole``.

    Words are compared in lower case and without marks, over line breaks. Every two documents that still
    share a run of ``RUN`` words share a piece. A piece stays where it stands first and goes elsewhere;
    the ends of a run beyond its outermost pieces, up to ``RUN - PIECE`` words each, stay.
    """
    doc = F.xxhash64("doc_id", "text_key")
    lines = F.sequence(F.col("para_no"), F.col("para_no") + F.col("n_lines") - 1)
    gone = (whole.where("removed").groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list(lines))).alias("_gone"))
            .withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}))
    spots = spots.select("seed", "doc_id", "text_key", "para_no", "_last", "word_no")
    left = stored(spots.join(gone, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
                  .where(~F.coalesce(F.exists("_gone", lambda p: p.between(F.col("para_no"), F.col("_last"))), F.lit(False))).drop("_id", "_key", "_gone"))
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_key").alias("c"), F.col("word_no").alias("d"))
    firsts = stored(left.groupBy("seed").agg(F.min(place).alias("_first"), F.min(doc).alias("x"), F.max(doc).alias("y"))
                    .where("x <> y").select("seed", "_first"))
    return (left.join(firsts, "seed")
            .select("doc_id", "text_key", "para_no", (F.col("_last") - F.col("para_no") + 1).alias("n_lines"), "word_no",
                    F.lit(PIECE).cast("int").alias("n_words"), F.col("_first.b").alias("cluster_id"),
                    (~place.eqNullSafe(F.col("_first"))).alias("removed")).distinct())


def _clusters(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Components (node, root) of the paragraphs that share a band and are alike."""
    edges = stored(_similar(members.where("key <> lead").select(F.col("key").alias("a"), F.col("lead").alias("b")).distinct(), sets, threshold))
    roots = components(edges)
    # A paragraph that is not like its bucket's first may still be like another one there.
    grouped = members.join(roots, members["key"] == roots["node"], "left").select("band", "key", F.coalesce("root", "key").alias("part"))
    mixed = grouped.groupBy("band").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2")
    rest = stored(grouped.join(mixed.select("band", "n"), "band"))
    if rest.isEmpty():
        return roots
    return components(edges.union(_residual(rest, sets, threshold)))


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose exact Jaccard similarity reaches the threshold."""
    both = (pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= threshold * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def _residual(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between different components that meet in a bucket, block by block.

    A bucket's paragraphs are dealt to chunks, and each pair of chunks is one small group, so no
    task holds a large bucket. Only pairs that are not connected yet are compared.
    """
    chunks = F.ceil(F.col("n") / CHUNK).cast("long")
    mine = F.pmod(F.xxhash64("key", F.lit(3)), chunks)
    placed = rest.withColumn("_c", mine).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    dealt = placed.select("band", F.least("_c", "_o").alias("i"), F.greatest("_c", "_o").alias("j"), "key", "part").join(sets, "key")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        keys, parts = group["key"].to_list(), group["part"].to_list()
        found, rows = [], [frozenset(x) for x in group["shingles"]]
        order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
        for n, x in enumerate(order):
            for y in order[n + 1:]:
                if len(rows[x]) < threshold * len(rows[y]) - 1e-9:
                    break
                if parts[x] == parts[y]:
                    continue
                common = len(rows[x] & rows[y])
                if common >= threshold * (len(rows[x]) + len(rows[y]) - common) - 1e-9:
                    found.append((keys[x], keys[y]))
                    old, new = parts[y], parts[x]
                    parts = [new if p == old else p for p in parts]
        return pd.DataFrame(found, columns=["a", "b"])

    return dealt.groupBy("band", "i", "j").applyInPandas(compare, "a long, b long")


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the removed paragraphs and passages; rows and columns stay, a text may end up empty."""
    lines = F.sequence(F.col("para_no"), F.col("para_no") + F.col("n_lines") - 1)
    gone = (found.where("removed").groupBy("doc_id", "text_key")
            .agg(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("word_no").isNull(), lines)))).alias("_gone"),
                 F.collect_set("word_no").alias("_pieces"))
            .withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}))
    keyed = docs.withColumn("_of", F.xxhash64("text"))

    @F.pandas_udf("string")
    def without(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, paras, pieces in batches:
            yield pd.Series([_without(*x) for x in zip(texts, paras, pieces, strict=True)], dtype="object")

    text = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    joined = keyed.join(gone, (F.col("_of") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return (joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).when(F.size("_pieces") == 0, text)
                              .otherwise(without(F.when(F.size("_pieces") > 0, F.col("text")), "_gone", "_pieces"))).select(*docs.columns))


def _without(text: str | None, gone: np.ndarray | None, pieces: np.ndarray | None) -> str | None:
    """``text`` without lines ``gone`` and the words of the pieces that begin at words ``pieces``."""
    if text is None:
        return None
    cut = {k + n for k in pieces for n in range(PIECE)}
    gone, out, no = set(gone), [], 0
    for n, line in enumerate(text.split("\n")):
        kept, at, any_cut = [], 0, False
        for m in WORDS.finditer(line):
            if no in cut:
                # What stands between removed words goes with them.
                if not any_cut or no - 1 not in cut:
                    kept.append(line[at:m.start()])
                at, any_cut = m.end(), True
            no += 1
        rest = "".join(kept) + line[at:]
        if n not in gone and (not any_cut or WORDS.search(rest)):
            out.append(rest)
    return "\n".join(out)
