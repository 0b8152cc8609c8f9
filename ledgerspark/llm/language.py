"""Language identification by piece unigrams summed over all segmentations."""

import uuid
from collections import Counter
from collections.abc import Iterator
from math import log

import ahocorasick
import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import per_worker, stored

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")  # fractions, raised and circled digits are no letters
FLOOR = 1e-9  # probability of a character that is no piece
SMALL = 1e-250
STEP = 96  # characters of a longer word that are scored as one


def pieces(path: str) -> frozenset[str]:
    """Pieces of a public vocabulary made of letters, with ``▁`` for the start of a word."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return frozenset(p for p in (p.lower() for p in every) if p and regex.fullmatch(r"▁?[\p{L}\p{M}]*", p))


def words(text: str) -> list[str]:
    """Lower-case words of letters, each with the mark of its start."""
    found = LETTERS.findall(text.lower())
    if found and len(max(found, key=len)) >= STEP:
        found = [w[i:i + STEP] for w in found for i in range(0, len(w), STEP)]
    return ["▁" + w for w in found]


class Model:
    """Piece probabilities per language and the forward sum over all segmentations of a word.

    A bounded number of distinct words is remembered, then all are forgotten.
    """

    def __init__(self, langs: list[str], table: dict[str, list[float]], longest: int):
        self.key = uuid.uuid4().hex
        self.langs, self.table, self.longest = langs, table, longest
        self.probs = np.array([*table.values()])
        self.lengths = np.array([len(p) for p in table], np.int64)
        self.pieces = None  # automaton over all pieces, built where it is used
        self.ids: dict[str, int] = {}
        self.scores = np.empty((1024, len(langs)))
        self.room = 2_000_000 // max(4, len(langs))

    def forward(self, word: str, k: int) -> list[float]:
        """Total probability of all segmentations of each prefix of a word in language ``k``."""
        table, longest = self.table, self.longest
        alpha = [1.0]
        for end in range(1, len(word) + 1):
            total = alpha[end - 1] * FLOOR
            for start in range(max(0, end - longest), end):
                p = table.get(word[start:end])
                if p is not None:
                    total += alpha[start] * p[k]
            alpha.append(total)
        return alpha

    def learn(self, found: set[str]) -> None:
        """Add log probabilities of new words in every language, words of like length together."""
        new = sorted(found, key=len)
        for i in range(0, len(new), 4096):
            self._learn(new[i:i + 4096])

    def _learn(self, group: list[str]) -> None:
        if self.pieces is None:
            self.pieces = ahocorasick.Automaton()
            for n, p in enumerate(self.table):
                self.pieces.add_word(p, n)
            self.pieces.make_automaton()
        # All pieces in all words: where they end, in which word, which they are.
        sizes = np.array([len(w) for w in group])
        starts = np.cumsum(sizes + 1) - sizes - 1
        ends, ids = np.array([*self.pieces.iter(" ".join(group))], np.int64).reshape(-1, 2).T
        word = np.searchsorted(starts, ends, "right") - 1
        place, length = ends - starts[word] + 1, self.lengths[ids]
        order = np.lexsort((length, place))
        word, place, length, ids = word[order], place[order], length[order], ids[order]
        cuts = np.flatnonzero(np.diff(place * (self.longest + 1) + length, prepend=-1, append=-1))
        alpha = np.zeros((int(sizes.max()) + 1, len(group), len(self.langs)))
        alpha[0] = 1.0
        scale = np.zeros(alpha.shape[1:])
        logs = np.zeros(alpha.shape[1:])
        k = 0
        for end in range(1, len(alpha)):
            total = alpha[end - 1] * FLOOR
            while k + 1 < len(cuts) and place[cuts[k]] == end:
                some = slice(cuts[k], cuts[k + 1])
                # A word has one piece at most of this length that ends here.
                total[word[some]] += alpha[end - length[cuts[k]], word[some]] * self.probs[ids[some]]
                k += 1
            alpha[end] = total
            if (low := total < SMALL).any():
                # Long words: the sums still needed are lifted together.
                alpha[:max(0, end + 1 - self.longest)] = 0.0
                alpha *= np.where(low, 1 / SMALL, 1.0)
                scale += np.where(low, log(SMALL), 0.0)
            done = sizes == end
            logs[done] = np.log(alpha[end, done]) + scale[done]
        first = len(self.ids)
        self.ids.update((w, first + n) for n, w in enumerate(group))
        while len(self.scores) < len(self.ids):
            self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
        self.scores[first:first + len(group)] = logs

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log probability of whole texts in each language; None without a letter."""
        out: list[np.ndarray | None] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(words(text) if text else [])
            size += len(group[-1])
            if size > 200_000:
                out += self._score(group)
                group, size = [], 0
        return out + self._score(group)

    def _score(self, group: list[list[str]]) -> list[np.ndarray | None]:
        if len(self.ids) > self.room:
            self.ids.clear()
        # New words of many texts are learned together.
        self.learn({w for found in group for w in found if w not in self.ids})
        return [self.scores[[*map(self.ids.__getitem__, found)]].sum(0) if found else None for found in group]


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of its id leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, path: str, sample: int = 300, rounds: int = 2) -> Model:
    """Learn piece probabilities by expectation maximisation over all segmentations.

    Learns from at most ``sample`` documents of each language, chosen by hash, out of those that
    have id and language and are not held out. Expected piece counts of distinct words are
    summed by Spark; what comes to the driver is bounded by vocabulary times languages.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("doc_id", "lang").distinct().withColumn("_n", place).where(F.col("_n") <= sample).drop("_n")
    langs = sorted(r[0] for r in chosen.select("lang").distinct().collect())
    vocabulary = pieces(path)
    longest = max(map(len, vocabulary))
    table = {p: [1.0 / len(vocabulary)] * max(1, len(langs)) for p in vocabulary}
    if not langs:
        return Model([], table, longest)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                n = Counter(w for t in texts for w in words(t))
                yield pd.DataFrame({"lang": lang, "word": n.keys(), "n": n.values()})

    # The sample is bounded by ``sample`` rows a language.
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    counted = stored(rows.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
                     .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        sums = _expect(counted, Model(langs, table, longest))
        smooth = 0.01
        totals = {k: sum(s[k] for s in sums.values()) + smooth * len(vocabulary) for k in range(len(langs))}
        table = {p: [((sums[p][k] if p in sums else 0.0) + smooth) / totals[k] for k in range(len(langs))] for p in vocabulary}
    return Model(langs, table, longest)


def _expect(counted: DataFrame, model: Model) -> dict[str, list[float]]:
    """Expected count of each piece in each language, given the present probabilities."""
    place = {lang: k for k, lang in enumerate(model.langs)}

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: Counter = Counter()
            for lang, word, n in batch.itertuples(index=False):
                k = place[lang]
                before = model.forward(word, k)
                total, size = before[-1], len(word)
                if total <= 0.0:
                    continue  # a long word without known pieces teaches nothing
                after = [0.0] * size + [1.0]
                for start in range(size - 1, -1, -1):
                    rest = after[start + 1] * FLOOR
                    for end in range(start + 1, min(size, start + model.longest) + 1):
                        p = model.table.get(word[start:end])
                        if p is not None:
                            rest += p[k] * after[end]
                            sums[k, word[start:end]] += n * before[start] * p[k] * after[end] / total
                    after[start] = rest
            yield pd.DataFrame([(k, p, n) for (k, p), n in sums.items()], columns=["k", "piece", "n"])

    rows = counted.mapInPandas(expect, "k int, piece string, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).collect()
    out: dict[str, list[float]] = {}
    for k, piece, n in rows:
        out.setdefault(piece, [0.0] * len(model.langs))[k] = n
    return out


def identify(docs: DataFrame, path: str, sample: int = 300) -> DataFrame:
    """Rows ``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for every row of ``docs``.

    ``score`` is the share of the predicted language in the probability of the text, all languages
    being equally likely beforehand. A null text, a text without a letter and any text when no
    language was learned give ``und`` with score 0. A null doc_id is neither held out nor learned
    from. Ties go to the first language in code point order.
    """
    model = fit(docs, path, sample)
    langs = model.langs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = per_worker("language", model.key, lambda: model)
        for batch in batches:
            names, scores = [], []
            texts = batch.pop("_text")
            for logs in known.texts(list(texts)) if langs else [None] * len(texts):
                if logs is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(logs.argmax())
                names.append(langs[best])
                scores.append(float(1 / np.exp(np.minimum(logs - logs[best], 0)).sum()))
            batch["lang_pred"], batch["score"] = names, scores
            yield batch

    slim = docs.select("doc_id", held_out().alias("held_out"), F.col("text").alias("_text"))
    kind = dict(docs.dtypes)["doc_id"]
    return slim.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
