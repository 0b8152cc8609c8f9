"""Benchmark decontamination: a BM25 index of test items queried with every passage."""

import re
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest
from itertools import repeat
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored

WORDS = re.compile(r"\w+")
ENDS = re.compile(r"[.!?]\s+|\n")
K1, B = 1.2, 0.75
BLOCK = 8  # items of one maximum
ROWS, CHARS = 500, 2_000_000  # texts, and their characters, whose passages are bounded at once
SHINGLE = 5
NEED = 0.8


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def shingles(found: list[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; the whole sequence if there are fewer words."""
    return {*zip(*(found[k:] for k in range(SHINGLE)), strict=False)} if len(found) >= SHINGLE else {tuple(found)}


def shingles_of(passage: list[str], checks: list[set]) -> set[tuple[str, ...]]:
    """Shingles of a passage in all lengths that the checks have."""
    return {s for size in {len(next(iter(c))) for c in checks} for s in zip(*(passage[k:] for k in range(size)), strict=False)}


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item up to its last sentence, and of its last sentence of five words or more.

    Text after that sentence belongs to the answer. An item of one such sentence is all question.
    """
    every = words(text)
    at, cut = 0, 0
    starts = [0, *(m.end() for m in ENDS.finditer(text))]
    for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
        n = len(words(text[a:b]))
        if n >= SHINGLE:
            cut = at
        at += n
    return (every[:cut], every[cut:]) if cut >= SHINGLE else (every, [])


class Index:
    """Inverted index of items, with the largest weight of each word in each block of items.

    A word's BM25 weight in an item is given as a share of what the item's own words score. An
    item's threshold is what must be left of that when as many words are missing as
    the check of its shingles allows, so no item that would pass the check is lost.
    """

    def __init__(self, items: list[tuple], idf: dict[str, float], mean: float):
        self.items, ready = [], []
        common = max(BLOCK, 0.05 * len(items))
        said = Counter(w for _, text in items for w in set(words(text)))
        for name, text in items:
            found = words(text)
            if not found:
                continue
            times = Counter(found)
            norm = K1 * (1 - B + B * len(found) / mean)
            parts = {w: idf[w] * f * (K1 + 1) / (f + norm) for w, f in times.items()}
            own = sum(parts.values())
            parts = {w: x / own for w, x in parts.items()}
            asked, answer = question_and_answer(text)
            checks = [shingles(x) for x in (asked, answer) if x]
            missing = sum(len(c) - ceil(NEED * len(c) - 1e-9) for c in checks)
            least = max(1 - sum(nlargest(missing, parts.values())), 0.0) - 1e-9
            # Words of many items bound little: they are taken as present, and only the others are looked up.
            rare = {w: x for w, x in parts.items() if said[w] <= common}
            left = least - (1 - sum(rare.values()))
            bounds = {w: x / left for w, x in rare.items()} if left >= 0.1 else {w: x / max(least, 1e-6) for w, x in parts.items()}
            half = max(16, 1 << (len(found) - 1).bit_length())
            ready.append((half, name, parts, least, checks, bounds))
        ready.sort(key=lambda r: r[:2])
        blocks: list[list[int]] = []
        for n, r in enumerate(ready):
            # A block holds items of one length class, whose passages are equally long.
            if not blocks or len(blocks[-1]) == BLOCK or ready[blocks[-1][0]][0] != r[0]:
                blocks.append([])
            blocks[-1].append(n)
        self.items = [r[1:5] for r in ready]
        self.blocks = blocks
        self.half = np.array([ready[b[0]][0] for b in blocks], np.int64)
        best: dict[str, dict[int, float]] = {}
        for k, block in enumerate(blocks):
            for n in block:
                for w, x in ready[n][5].items():
                    row = best.setdefault(w, {})
                    row[k] = max(x, row.get(k, 0.0))
        self.rows = {w: n for n, w in enumerate(best)}
        self.starts = np.cumsum([0, *(len(r) for r in best.values())])
        self.block = np.array([k for r in best.values() for k in r], np.int64)
        self.bound = np.array([x for r in best.values() for x in r.values()])

    def matches(self, texts: list[str]) -> Iterator[tuple[int, tuple]]:
        """Number of a text and item, score, question, answer, first word and length of the best passage.

        A passage is a window of two halves; a half is no shorter than any item of the block, and
        windows overlap by a half, so every item stands whole in one. Block maxima of all words
        are added up for all pairs of passage and block at once, and only blocks whose sum
        reaches the threshold are opened.
        """
        if not self.items:
            return
        said = [words(t) for t in texts]
        for at, passages in self._reached(said):
            best: dict[int, tuple] = {}
            for block, first in passages:
                self._open(said[at], block, first, best)
            for n in sorted(best):
                yield at, best[n]

    def _reached(self, said: list[list[str]]) -> Iterator[tuple[int, list]]:
        rows = [np.array([*map(self.rows.get, found, repeat(-1))], np.int64) for found in said]
        doc = np.repeat(np.arange(len(said)), [len(r) for r in rows])
        place = np.concatenate([np.arange(len(r)) for r in rows]) if rows else doc
        row = np.concatenate(rows) if rows else doc
        doc, place, row = doc[row >= 0], place[row >= 0], row[row >= 0]
        n = self.starts[row + 1] - self.starts[row]
        entry = np.repeat(self.starts[row] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        block, bound = self.block[entry], self.bound[entry]
        window = np.repeat(place, n) // self.half[block]
        key = (np.repeat(doc, n) * len(self.blocks) + block) << 32 | window
        key = np.concatenate([key, key[window > 0] - 1])
        keys, at = np.unique(key, return_inverse=True)
        sums = np.bincount(at, np.concatenate([bound, bound[window > 0]]), len(keys))
        out: dict[int, list] = {}
        for k in keys[sums >= 1 - 1e-6].tolist():
            d, b = divmod(k >> 32, len(self.blocks))
            out.setdefault(d, []).append((b, int((k & 0xFFFFFFFF) * self.half[b])))
        yield from out.items()

    def _open(self, found: list[str], block: int, first: int, best: dict[int, tuple]) -> None:
        passage = found[first:first + 2 * int(self.half[block])]
        inside, have = set(passage), None
        for n in self.blocks[block]:
            name, parts, least, checks = self.items[n]
            score = sum(x for w, x in parts.items() if w in inside)
            if score < least or (n in best and score <= best[n][1]):
                continue
            have = shingles_of(passage, checks) if have is None else have | shingles_of(passage, checks)
            shares = [len(c & have) / len(c) for c in checks]
            if min(shares) >= NEED:
                best[n] = (name, score, shares[0], shares[1] if len(shares) > 1 else 1.0, first, len(passage))


def _indexes(items: DataFrame, most: int) -> Iterator[Index]:
    """Indexes over all items, each made of at most about ``most`` bytes of text.

    Frequencies and lengths are those of all items. One index at a time comes to the driver.
    """
    known = stored(items.where("item_id is not null and text is not null").select("item_id", "text"))

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words)

    said = stored(known.select("item_id", split("text").alias("_w")))
    spread = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    n, size = known.agg(F.count("*"), spread).first()
    if not n:
        return
    mean = said.agg(F.avg(F.size("_w"))).first()[0] or 1.0
    held = stored(said.select(F.explode(F.array_distinct("_w")).alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    groups = max(1, -(-size // most))
    for g in range(groups):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g
        idf = held.join(said.where(mine).select(F.explode("_w").alias("word")).distinct(), "word").collect()
        yield Index([tuple(r) for r in known.where(mine).collect()],
                    {r["word"]: log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5)) for r in idf}, mean)


def find(docs: DataFrame, items: DataFrame, most: int = 16_000_000) -> DataFrame:
    """Verified leaks: ``doc_id``, ``item_id``, ``score``, ``question``, ``answer``, ``first_word``, ``n_words``.

    Every passage of every document queries the BM25 index; all items that reach their threshold
    are verified: 0.8 of the five-word shingles of the question and of the answer must stand in the
    passage. Words are compared in lower case without marks. A document and
    item give one row, that of the best passage. Null or wordless texts and items, and items
    without id, match nothing; repeated rows give repeated results. Items beyond ``most`` bytes are
    indexed in several parts, each of which reads the documents once.
    """
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question double, answer double, first_word long, n_words long"
    slim = docs.where("text is not null").select("doc_id", "text")
    out = None
    for index in _indexes(items, most):
        part = slim.mapInPandas(_finder(index), schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of at most ``ROWS`` texts and ``CHARS`` characters, or of one longer text; each with its start."""
    start, size = 0, 0
    for n, text in enumerate(texts):
        if n > start and (n - start == ROWS or size + len(text) > CHARS):
            yield start, texts[start:n]
            start, size = n, 0
        size += len(text)
    if texts:
        yield start, texts[start:]


def _finder(index: Index):
    names = ["doc_id", "item_id", "score", "question", "answer", "first_word", "n_words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = list(batch["doc_id"])
            for i, texts in _runs(list(batch["text"])):
                yield pd.DataFrame([(ids[i + n], *m) for n, m in index.matches(texts)], columns=names)
    return run


def _leak_test(index: Index):
    @F.pandas_udf("boolean")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            hit = np.zeros(len(texts), bool)
            for i, run in _runs(list(texts)):
                hit[[i + n for n, _ in index.matches(run)]] = True
            yield pd.Series(hit)
    return leaks


def clean(docs: DataFrame, items: DataFrame, most: int = 16_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no verified leak; null text holds none. Columns stay."""
    for index in _indexes(items, most):
        docs = docs.where(~_leak_test(index)(F.coalesce("text", F.lit(""))))
    return docs
