"""Quality rules: text statistics and a decision list learned from labelled documents."""

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
FEATURES = ("n_words", "word_length", "symbols", "dup_lines", "repeats", "line_words", "upper", "digits", "marks")


def count(text: str) -> tuple:
    """The statistics named in ``COUNTS`` of one text."""
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space only
    n = len(words)
    size = len(data)
    less = lambda marks: size - len(data.translate(None, marks))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return (n, len(text) - less(BLANKS), less(SYMBOLS), len(lines) - len(set(lines)), _repeat_words(words),
            len(lines), less(UPPER), less(DIGITS), less(MARKS))


def _repeat_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more."""
    windows = [*zip(words, words[1:], words[2:], strict=False)]
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    total, covered = 0, 0
    for at, w in enumerate(windows):
        if w in twice:
            total += at + 3 - max(at, covered)
            covered = at + 3
    return total


def with_counts(docs: DataFrame, name: str = "_q") -> DataFrame:
    """Add the struct ``name`` with the statistics of ``text``; null counts as empty."""
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([count(t) for t in texts], columns=COUNTS)

    return docs.withColumn(name, run(F.coalesce(F.col("text"), F.lit(""))))


def features(q: str = "_q") -> dict[str, Column]:
    """What the learned rules test, from the struct of statistics."""
    c = {x: F.col(f"{q}.{x}") for x in COUNTS}
    per = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0))
    return dict(zip(FEATURES, (c["n_words"].cast("double"), per("word_chars", "n_words"), per("n_symbols", "n_words"),
                               per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("n_words", "n_lines"),
                               per("n_upper", "word_chars"), per("n_digits", "word_chars"), per("n_marks", "n_words")),
                    strict=True))


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.97, cover: int = 5, literals: int = 4,
          seed: int = 7) -> list[list[tuple[int, bool, float]]]:
    """Sequential covering: ordered conjunctions of (feature, at least?, threshold) that find bad rows.

    Each rule grows on two thirds of the rows left by the threshold of most gain, and is pruned
    from its end on the other third. Learning stops at the first rule that is right in less
    than ``precision`` of the rows it covers, or finds fewer than ``cover``.
    """
    rules: list[list[tuple[int, bool, float]]] = []
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    while (bad & left & part).any():
        rule = _grow(x[left & part], bad[left & part], literals)
        held = left & ~part
        worth = lambda k: _worth(_covers(x[held], rule[:k]), bad[held])  # noqa: B023, E731
        rule = rule[:max(range(len(rule), 0, -1), key=worth)] if rule else rule
        hit = left & _covers(x, rule)
        if not rule or (hit & bad).sum() < cover or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def _covers(x: np.ndarray, rule: list) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, least, at in rule:
        hit &= (x[:, f] >= at) if least else (x[:, f] < at)
    return hit


def _worth(hit: np.ndarray, bad: np.ndarray) -> float:
    right = (hit & bad).sum()
    return (2 * right - hit.sum()) / hit.sum() if hit.any() else -1.0


def _grow(x: np.ndarray, bad: np.ndarray, literals: int) -> list:
    rule: list[tuple[int, bool, float]] = []
    while len(rule) < literals and bad.any() and not bad.all():
        before = np.log2(bad.mean())
        best = (0.0, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, 65), method="nearest"))
            for a, b in pairwise(cuts):
                at = float((a + b) / 2)
                over = x[:, f] >= at
                for least, hit in ((True, over), (False, ~over)):
                    right = (hit & bad).sum()
                    gain = right * (np.log2(right / hit.sum()) - before) if right else 0.0
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, least, at))
        if best[1] is None:
            break
        rule.append(best[1])
        hit = _covers(x, rule[-1:])
        x, bad = x[hit], bad[hit]
    return rule


def verdict(rules: list, q: str = "_q") -> Column:
    """The decision list as one conditional expression: true unless a rule rejects."""
    tested = list(features(q).values())
    out = None
    for rule in rules:
        hit = F.lit(True)
        for f, least, at in rule:
            hit = hit & ((tested[f] >= at) if least else (tested[f] < at))
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000) -> list:
    """Learn a decision list from at most ``sample`` labelled documents, chosen by hash.

    Labels are quality 0 (bad) or 1 by doc_id. Null ids and labels, and ids labelled both ways,
    are left out. Without labelled documents of both kinds there are no rules.
    """
    clear = (labels.where("doc_id is not null and quality is not null")
             .groupBy("doc_id").agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
             .where("_low = _high").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    chosen = stored(clear.select("doc_id", (F.col("_low") == 0).alias("_bad")))
    # The sample's size is bounded, so it may be sent to every task.
    rows = with_counts(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    seen = (rows.select("doc_id", "_bad", *(v.alias(k) for k, v in features().items())).dropDuplicates(["doc_id"])
            .toPandas().sort_values("doc_id"))
    return learn(seen[list(FEATURES)].to_numpy(float), seen["_bad"].to_numpy(bool))


def judge(docs: DataFrame, labels: DataFrame, sample: int = 10_000) -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed`` and ``kept`` to ``docs`` (doc_id, text); columns of these names are replaced.

    A document fails at once with fewer than 50 words or when over half of its words stand in
    repeated windows; the learned list decides the others. Every row is kept, null text counts
    as empty. The rules are fitted before the result is built.
    """
    rules = fit(docs, labels, sample)
    shown = COUNTS[:5]
    q = with_counts(docs.drop("_q"))
    failed = (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))
    return q.withColumns({c: F.col(f"_q.{c}") for c in shown} | {"base_failed": failed, "kept": ~failed & verdict(rules)}).drop("_q")
