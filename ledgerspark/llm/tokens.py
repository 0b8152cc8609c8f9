"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies."""

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import per_worker

# The splitting pattern of byte-level BPE, cut so that each unit splits alike whatever stands
# around it: white space before a word goes with the word.
UNIT = regex.compile(r" ?\p{L}++|(?:\s*[^\S ])?'(?:s|t|re|ve|m|ll|d)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
UNIT_PARTS = regex.compile(r"(\s*)(.*)", regex.S)
HEAD = 8
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class PrefixCounter:
    """Token counts of all prefixes of a text under one vocabulary file.

    A prefix of n bytes ends in the one token that could follow the encoding of what stands
    before it without any merge across the border, so its count is one more than the count
    there. ``cache`` words of up to ``long`` characters are remembered, then all are forgotten.
    """

    def __init__(self, path: str, cache: int = 1_500_000, long: int = 64):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        byte_of = {c: b for b, c in _printable().items()}
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.ids = ids = {raw(t): n for t, n in model["vocab"].items()}
        self.rank = {}
        self.parts = {}
        for n, merge in enumerate(model["merges"]):
            a, b = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            self.rank[ids[a], ids[b]] = n
            self.parts.setdefault(ids[a + b], (n, ids[a], ids[b]))
        self.longest = max(map(len, ids))
        if self.longest > 128:
            raise ValueError("a step of the prefix counts must fit one byte")
        specials = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.specials = frozenset(specials)
        self.cache, self.room, self.long = {}, cache, long
        self.edges = {}, {}
        self.fits, self.heads = {}, {}

    def steps(self, text: str) -> bytes:
        """One signed byte per character: how much the count changes with it."""
        if self.special and any(s in text for s in self.specials):
            parts = [p for p in self.special.split(text) if p]
            out, before = [], ""
            for p in parts:
                if p in self.specials:
                    # Until it is complete the string is ordinary text that goes on from what stands before it.
                    counts = self.counts(before + p[:-1])[len(before):]
                    start = self.counts(before)[-1] if before else 0
                    steps = [b - a for a, b in zip([start, *counts], [*counts, start + 1], strict=True)]
                    out.append(bytes(x & 255 for x in steps))
                    before = ""
                else:
                    out.append(self._plain(p))
                    before = p
            return b"".join(out)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        # A blank before a character that is not white space starts a unit, so words with the
        # blank before them can be looked up. Texts with other blanks go unit by unit.
        first, *words = text.split(" ")
        cache = self.cache
        try:
            known = [*map(cache.__getitem__, words)]
        except KeyError:
            if len(cache) > self.room:
                cache.clear()
            known = []
            for w in words:
                steps = cache.get(w)
                if steps is None:
                    if not w or w[0].isspace():
                        return b"".join(map(self._unit, UNIT.findall(text)))
                    if w[-1] in ",." and w[-2:-1].isalpha() and w[:-1] in cache:
                        steps = cache[w[:-1]] + b"\x01"
                    else:
                        steps = b"".join(map(self._unit, UNIT.findall(" " + w)))
                    if len(w) <= self.long:
                        cache[w] = steps
                known.append(steps)
        return b"".join([*map(self._unit, UNIT.findall(first)), *known])

    def counts(self, text: str) -> list[int]:
        """Tokens of every prefix of ``text`` of one character and more."""
        total, out = 0, []
        for step in self.steps(text):
            total += step - 256 if step > 127 else step
            out.append(total)
        return out

    def _unit(self, unit: str) -> bytes:
        space, core = UNIT_PARTS.match(unit).groups()
        if space in ("", " ") and (space or core not in CONTRACTIONS):
            counts = self.piece(unit)
            return bytes([(b - a) & 255 for a, b in zip([0, *counts], counts, strict=False)])
        counts = self.piece(space) if space else []
        if core:
            # The last blank of a run joins the word; any other character stands alone.
            if space.endswith(" "):
                head, word, skip = space[:-1], " " + core, 1
            else:
                head, word, skip = space, core, 0
            pieces = [head[:-1], head[-1:]] if head and not skip else [head]
            base = sum(self.piece(p)[-1] for p in pieces if p)
            if core in CONTRACTIONS and not skip:
                alone = self.piece("'")[0]
                inner = [alone] + [alone + n for n in self.piece(core[1:])[:-1]] + [self.piece(core)[-1]]
            else:
                inner = self.piece(word)[skip:]
            counts = counts + [base + n for n in inner]
        return bytes((b - a) & 255 for a, b in zip([0, *counts], counts, strict=False))

    def piece(self, text: str) -> list[int]:
        """Token count of every prefix of one piece, by characters."""
        data = text.encode()
        find, longest, known, border = self.ids.get, self.longest, self.fits, self._border
        if len(known) > self.room:
            known.clear()
        # Words share their beginnings, and prefixes of one beginning are one computation.
        shared = self.heads.get(data[:HEAD]) if len(data) > HEAD else None
        last, count = (shared[0][:], shared[1][:]) if shared else ([-1], [0])
        for end in range(len(last), len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = find(data[start:end])
                if token is not None:
                    if start:
                        pair = last[start] << 20 | token
                        fits = known.get(pair)
                        if fits is None:
                            fits = known[pair] = border(last[start], token)
                        if not fits:
                            continue
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        if len(data) > HEAD and not shared:
            if len(self.heads) > self.room // 10:
                self.heads.clear()
            self.heads[data[:HEAD]] = last[:HEAD + 1], count[:HEAD + 1]
        if len(data) == len(text):
            return count[1:]
        ends, at = [], 0
        for c in text:
            at += len(c.encode())
            ends.append(count[at])
        return ends

    def _border(self, left: int, right: int) -> bool:
        """Whether the encoding of two tokens' bytes is just these two tokens."""
        lefts, rights = self._edge(left, 2), self._edge(right, 1)
        never, rank = len(self.rank) + 1, self.rank
        i, j = len(lefts) - 1, len(rights) - 1
        while True:
            # Rank at which the piece at the border is swallowed by a larger one of its own side.
            next_left = lefts[i][0] if i else never
            next_right = rights[j][0] if j else never
            across = rank.get((lefts[i][1], rights[j][1]), never)
            if across < next_left and across <= next_right and across < never:
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i -= 1
            else:
                j -= 1

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one end of a token, from the token itself down to its byte.

        Each comes with the rank of the merge that makes the one before it in the list.
        """
        known = self.edges[side - 1]
        if token not in known:
            pieces, t = [(-1, token)], token
            while t in self.parts:
                n, t = self.parts[t][0], self.parts[t][side]
                pieces.append((n, t))
            known[token] = pieces
        return known[token]


def _printable() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


def token_prefixes(docs: DataFrame, path: str) -> DataFrame:
    """Per document ``doc_id``, ``n_bytes``, ``n_tokens`` and ``steps``, its table of prefix counts.

    ``steps`` holds one signed byte per code point; the sum of the first k is the exact number
    of tokens of the first k code points. ``budget`` and ``truncate`` answer from it. Every row
    gives one row; a null text counts as empty (no steps, 0 tokens). A text's table is as
    long as the text, so memory per task is that of one Arrow batch of texts.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = per_worker("tokens", path, lambda: PrefixCounter(path))
        for batch in batches:
            steps = [counter.steps(t) for t in batch.pop("_text")]
            batch["steps"] = steps
            batch["n_tokens"] = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
            yield batch

    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    kind = dict(docs.dtypes)["doc_id"]
    return slim.mapInPandas(run, f"doc_id {kind}, n_bytes long, steps binary, n_tokens long")


def over_limit(prefixes: DataFrame, limit: int) -> DataFrame:
    """Add ``over_limit``: whether the whole text has more than ``limit`` tokens."""
    return prefixes.withColumn("over_limit", F.col("n_tokens") > limit)


def truncate(prefixes: DataFrame, limit: int) -> DataFrame:
    """Add ``n_chars``: the longest prefix, in code points, of at most ``limit`` tokens."""
    @F.pandas_udf("long")
    def longest(steps: pd.Series) -> pd.Series:
        out = []
        for s in steps:
            fits = np.flatnonzero(np.cumsum(np.frombuffer(s, np.int8), dtype=np.int64) <= limit)
            out.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pd.Series(out)

    return prefixes.withColumn("n_chars", longest("steps"))
