"""Batch product search: a table of queries against the catalogue, best products per query.

Five scorers rate a product's text. Exact and word matches are found through an index of short
substrings. The three similarity scorers rate every query against every distinct text by
definition: both sides are dealt to blocks, each pair of blocks is one small cell, and a
cell keeps only its best rows per query. Letter counts bound every score from above, and only
texts whose bound reaches the best scores so far are compared in full.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.similarity import (codes, full_ratio, letter_counts, partial_ratio, shared_letters,
                                              token_set_ratio)
from ledgerspark.functions.state import cut_lineage
from ledgerspark.functions.text import ascii_tokens, comparable, grams, search_query, search_text
from ledgerspark.operators.running import spread

# Fixed values of the ranking: weight per scorer, top score of a word match, cut-off, and
# how many rows per requested result a similarity scorer contributes.
WEIGHTS = {"exact": 1.2, "words": 1.0, "partial": 0.9, "token_sort": 0.8, "token_set": 0.7}
WORD_SCORE = 90.0
CUTOFF = 25
POOL = 3

SIMILAR = ("partial", "token_sort", "token_set")

# Mean queries and texts of a cell, texts and matrix elements that are compared at a time, and
# classes that letters are counted in.
QUERIES = 32
TEXTS = 2_048
OPENED = 256
CELLS = 2_000_000
CLASSES = 64
# Bounds are the same quotients as scores; this only guards against their last bit.
SLACK = 1e-9

_SCORES = "query string, scorer string, id_length int, product_id string, score double"


def prepare_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query) in lower case and trimmed; blank queries ask for nothing and go."""
    return (queries.select(F.col("query_id").cast("bigint").alias("query_id"),
                           search_query(F.col("query")).alias("query"))
            .filter(F.col("query") != ""))


def search_texts(products: DataFrame) -> DataFrame:
    """One row per distinct text, under the lowest id that has it. ``id_length`` and
    ``product_id`` together sort ids by number."""
    texts = products.select(search_text(F.col("name"), F.col("clean_name")).alias("text"),
                            F.length("product_id").alias("id_length"), "product_id")
    return (texts.groupBy("text").agg(F.min(F.struct("id_length", "product_id")).alias("first"))
            .select("text", "first.id_length", "first.product_id"))


def gram_index(texts: DataFrame) -> DataFrame:
    """Postings (gram, id_length, product_id): every distinct piece of one to three characters of a text.

    The text itself stays out of it. Worth storing where many batches of queries meet the same texts.
    """
    return texts.select(F.explode(grams(F.lower("text"))).alias("gram"), "id_length", "product_id")


def _rarest_pieces(words: DataFrame, postings: DataFrame) -> DataFrame:
    """(word, id_length, product_id): texts that hold the rarest of a word's pieces, for each distinct word.

    A piece has three characters, or is the whole word if that is shorter. However common the others
    are, only the postings of the rarest one go on.
    """
    size = F.least(F.length("word"), F.lit(3))
    pieces = words.select("word").distinct().select("word", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") - size + 1), lambda i: F.substr("word", i, size))).alias("gram"))
    lists = postings.join(pieces.select("gram").distinct(), "gram", "left_semi")
    sizes = lists.groupBy("gram").agg(F.count("*").alias("n"))
    # A piece that no text has comes first, and finds nothing.
    rarest = (pieces.join(sizes, "gram", "left").groupBy("word")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("first"))
              .select("word", F.col("first.gram").alias("gram")))
    return lists.join(rarest, "gram").select("word", "id_length", "product_id")


def match_scores(queries: DataFrame, texts: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """Exact (query inside the text) and word (share of query words inside the text) scores.

    ``postings`` is a stored ``gram_index`` of the texts; without it the index is made on the way. Texts
    are fetched only where they hold the rarest piece of a word, and looked at for the word and the whole
    query: a text that contains the query contains all its words.
    """
    words = (prepare_queries(queries)
             .select("query_id", "query", F.split("query", r"\s+").alias("words"))
             .select("query_id", "query", F.size("words").alias("n_words"), F.explode("words").alias("word"))
             .groupBy("query_id", "query", "n_words", "word").agg(F.count("*").alias("times")))
    able = _rarest_pieces(words, gram_index(texts) if postings is None else postings)
    hits = (spread(able, "product_id").join(texts.select("product_id", F.lower("text").alias("text")), "product_id")
            .filter(F.contains("text", "word")))
    found = (hits.join(words, "word")
             .select("query_id", "id_length", "product_id", "n_words", "times",
                     F.contains("text", "query").cast("int").alias("whole"))
             .groupBy("query_id", "id_length", "product_id", "n_words")
             .agg(F.sum("times").alias("hits"), F.max("whole").alias("whole")))
    word_score = F.col("hits") / F.col("n_words") * F.lit(WORD_SCORE)
    scores = F.array(F.struct(F.lit("words").alias("scorer"), word_score.alias("score")),
                     F.struct(F.lit("exact").alias("scorer"), F.when(F.col("whole") == 1, 100.0).alias("score")))
    return (found.select("query_id", "id_length", "product_id", F.inline(scores))
            .filter(F.col("score").isNotNull())
            .select("query_id", "scorer", "id_length", "product_id", "score"))


class _Cell:
    """The texts of a cell, and how similar each can be to a query at most.

    A common subsequence has no more of a letter than either side. The letters of every text are counted
    once, in a few classes that only make the bounds wider, so a bound costs a fraction of a score.
    """

    def __init__(self, texts: pd.DataFrame):
        # In the order that settles ties.
        self.texts = texts = texts.sort_values(["id_length", "product_id"], ignore_index=True)
        self.plain = texts["plain"].to_numpy(dtype=object)
        self.words = [list(w) for w in texts["words"]]
        self.sorted = np.array([" ".join(w) for w in self.words] + [None], dtype=object)[:-1]
        self.plain_letters, self.plain_lengths = letter_counts(self.plain, CLASSES)
        self.sorted_letters, self.sorted_lengths = letter_counts(self.sorted, CLASSES)
        self.set_lengths = np.array([len(" ".join(set(w))) for w in self.words], dtype=np.int64)
        self.sums: dict[int, np.ndarray] = {}
        self.holders: dict[str, list[int]] = {}
        for i, words in enumerate(self.words):
            for word in set(words):
                self.holders.setdefault(word, []).append(i)

    def _so_far(self, letter: int) -> np.ndarray:
        """How many letters of a class (-1: of all) each text has up to each place, a row per place."""
        if letter not in self.sums:
            found = self.classes == letter if letter >= 0 else self.classes >= 0
            self.sums[letter] = np.pad(np.cumsum(found, axis=0, dtype=np.int32), ((1, 0), (0, 0)))
        return self.sums[letter]

    def _in_windows(self, asked: str) -> np.ndarray:
        """For texts longer than the query: the highest score that a window's letters allow."""
        if not self.sums:
            letters, lengths = codes(self.plain.tolist())
            self.classes = np.where(np.arange(letters.shape[1])[:, None] < lengths, letters.T.astype(np.int64) % CLASSES, -1)
        mine = letter_counts([asked], CLASSES)[0][0]
        width, m = len(self.classes), len(asked)

        def within(letter: int) -> np.ndarray:
            sums = self._so_far(letter)
            ends = np.concatenate([sums[1:], np.broadcast_to(sums[-1], (m - 1, sums.shape[1]))])
            ends[m:] -= sums[1:width]
            return ends
        common = np.zeros((width + m - 1, len(self.plain)), dtype=np.int32)
        for letter in np.flatnonzero(mine):
            common += np.minimum(within(letter), mine[letter])
        return (200.0 * common / (m + within(-1))).max(axis=0)

    def bounds(self, query) -> dict[str, np.ndarray]:
        """Per scorer the highest score that each text can have."""
        asked, joined = query.plain, " ".join(query.words)
        common = shared_letters(asked, self.plain_letters)
        shorter = np.minimum(self.plain_lengths, len(asked))
        in_window = np.minimum(common, shorter)
        partial = 200.0 * in_window / np.maximum(shorter + in_window, 1)
        if asked and len(self.plain) * self.plain_lengths.max(initial=0) <= CELLS:
            partial = np.where(self.plain_lengths > len(asked), np.minimum(partial, self._in_windows(asked)), partial)
        in_words = shared_letters(joined, self.sorted_letters)
        sets = 200.0 * in_words / np.maximum(len(" ".join(set(query.words))) + self.set_lengths, 1)
        for word in set(query.words):  # a shared word counts whole, however long the rest
            sets[self.holders.get(word, [])] = 100.0
        return {"partial": partial,
                "token_sort": 200.0 * in_words / np.maximum(len(joined) + self.sorted_lengths, 1),
                "token_set": sets}

    def scores(self, scorer: str, query, rows: np.ndarray) -> np.ndarray:
        if scorer == "partial":
            return partial_ratio(query.plain, self.plain[rows].tolist())
        if scorer == "token_sort":
            return full_ratio(" ".join(query.words), self.sorted[rows].tolist())
        return token_set_ratio(list(query.words), [self.words[i] for i in rows])

    def best(self, scorer: str, query, bounds: np.ndarray, least: float, keep: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of the ``keep`` best texts with a score of at least ``least``, and how many were compared.

        Texts are opened from the highest bound down, a handful at a time, until no bound reaches the
        last of the ``keep`` best so far. Scores that tie with it are all seen: ids settle ties.
        """
        able = np.flatnonzero(bounds >= least - SLACK)
        able = able[np.argsort(-bounds[able], kind="stable")]
        rows, scores, start = np.empty(0, dtype=np.int64), np.empty(0), 0
        while start < len(able) and bounds[able[start]] >= least - SLACK:
            end = min(len(able), start + OPENED)
            # Long texts come in smaller handfuls, so padded matrices stay small.
            width = int(max(self.plain_lengths[able[start:end]].max(), self.sorted_lengths[able[start:end]].max(), 1))
            end = min(end, start + max(1, CELLS // width))
            found = self.scores(scorer, query, able[start:end])
            good = found >= least
            rows, scores = np.concatenate([rows, able[start:end][good]]), np.concatenate([scores, found[good]])
            if len(scores) > keep:
                least = max(least, np.partition(scores, -keep)[-keep])
                rows, scores = rows[scores >= least], scores[scores >= least]
            start = end
        order = np.lexsort((rows, -scores))[:keep]
        return rows[order], scores[order], start


def _similarities(keep: int, tally: bool = False):
    """Scoring function of a cell: the ``keep`` best of its texts per query and scorer, of those that reach
    the query's ``least`` scores. With ``tally`` it returns the numbers of texts compared instead."""
    def run(queries: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        cell, found, opened = _Cell(texts), [], []
        for query in queries.itertuples():
            for scorer, bounds in cell.bounds(query).items():
                # Scores are rounded to whole numbers before the cut-off applies.
                least = max(CUTOFF + 0.5, getattr(query, f"least_{scorer}"))
                rows, scores, compared = cell.best(scorer, query, bounds, least, keep)
                found.append((query.query, scorer, rows, scores))
                opened.append((query.query, scorer, len(texts), compared))
        if tally:
            return pd.DataFrame(opened, columns=["query", "scorer", "texts", "compared"])
        sizes = [len(rows) for _, _, rows, _ in found]
        rows = np.concatenate([np.empty(0, dtype=np.int64), *(rows for _, _, rows, _ in found)])
        best = cell.texts.loc[rows, ["id_length", "product_id"]].reset_index(drop=True)
        return best.assign(query=np.repeat([f[0] for f in found], sizes), scorer=np.repeat([f[1] for f in found], sizes),
                           score=np.concatenate([np.empty(0), *(f[3] for f in found)]))[["query", "scorer", "id_length", "product_id", "score"]]
    return run


def _scored_cells(queries: DataFrame, texts: DataFrame, limit: int, tally: bool = False) -> DataFrame:
    """The best texts of every cell, or with ``tally`` (query, scorer, texts, compared) of every cell.

    The numbers of blocks follow from the sizes of both sides, so a cell is small at every size, and nothing
    passes the driver. The first block of texts goes ahead: its last best score per query and scorer is what
    a text of any other block has to reach to be opened at all.
    """
    keep = POOL * limit
    # Comparing is heavy for the few bytes a text has, so the tasks are not sized by bytes.
    spark = queries.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    asked = prepare_queries(queries)

    def blocks(df: DataFrame, size: int):
        return df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size).cast("int"))).scalar()

    def dealt(df: DataFrame, mine: str, other: str, condition) -> DataFrame:
        """``df`` in blocks ``mine``, each row copied along the blocks ``other``."""
        return (df.withColumn("q_blocks", blocks(asked, QUERIES)).withColumn("t_blocks", blocks(texts, TEXTS))
                .withColumn(f"{mine}_block", F.pmod(F.xxhash64("plain", "words"), F.col(f"{mine}_blocks")).cast("int"))
                .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
                .filter(condition).drop("q_blocks", "t_blocks").repartition(tasks, "q_block", "t_block"))

    def scored(wanted: DataFrame, condition, schema: str = _SCORES, tally: bool = False) -> DataFrame:
        shaped = texts.select("id_length", "product_id", comparable(F.col("text")).alias("plain"),
                              ascii_tokens(F.col("text")).alias("words"))
        return (dealt(wanted, "q", "t", condition).groupBy("q_block", "t_block")
                .cogroup(dealt(shaped, "t", "q", condition).groupBy("q_block", "t_block"))
                .applyInPandas(_similarities(keep, tally), schema))

    wanted = asked.select("query").distinct().select(
        "query", comparable(F.col("query")).alias("plain"), ascii_tokens(F.col("query")).alias("words"))
    nothing = {f"least_{s}": F.lit(0.0) for s in SIMILAR}
    ahead, rest = F.col("t_block") == 0, F.col("t_block") > 0
    first = cut_lineage(scored(wanted.withColumns(nothing), ahead))
    last = first.groupBy("query").agg(*[
        F.when(F.count_if(F.col("scorer") == s) == keep, F.min(F.when(F.col("scorer") == s, F.col("score")))).alias(f"least_{s}")
        for s in SIMILAR])
    bounded = wanted.join(last, "query", "left").fillna(0.0, [f"least_{s}" for s in SIMILAR])
    if tally:
        counts = "query string, scorer string, texts long, compared long"
        return scored(wanted.withColumns(nothing), ahead, counts, True).unionByName(scored(bounded, rest, counts, True))
    return first.unionByName(scored(bounded, rest))


def similarity_scores(queries: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """Partial, token-sort and token-set scores: per query and scorer the best 3 x limit texts.

    Queries with the same text are compared once.
    """
    keep = POOL * limit
    order = Window.partitionBy("query", "scorer").orderBy(F.col("score").desc(), "id_length", "product_id")
    best = (_scored_cells(queries, texts, limit).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
            .select("query", "scorer", "id_length", "product_id", F.bround("score").alias("score")))
    return best.join(prepare_queries(queries), "query").select("query_id", "scorer", "id_length", "product_id", "score")


def compared_shares(queries: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """(scorer, pairs, compared): pairs of query and text, and how many of them a search compares in full."""
    return (_scored_cells(queries, texts, limit, tally=True).groupBy("scorer")
            .agg(F.sum("texts").alias("pairs"), F.sum("compared").alias("compared")))


def rank_scores(scores: DataFrame, limit: int) -> DataFrame:
    """The best products per query by highest weighted, then highest plain score."""
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("scorer"))
    best = (scores.filter(F.col("score") > CUTOFF)
            .groupBy("query_id", "id_length", "product_id")
            .agg(F.max("score").alias("max_score"), F.max(F.col("score") * weight).alias("weighted_score")))
    order = Window.partitionBy("query_id").orderBy(
        F.col("weighted_score").desc(), F.col("max_score").desc(), "id_length", "product_id")
    return (best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
            .select("query_id", "place", "product_id", F.floor("max_score").cast("int").alias("score"),
                    "weighted_score"))


def search_products(queries: DataFrame, products: DataFrame, limit: int = 10, fuzzy: bool = True) -> DataFrame:
    """(query_id, place, product_id, name, score, ...) for the best ``limit`` products per query.

    With ``fuzzy=False`` only exact and word matches count. Products that share one text
    are represented by the lowest id.
    """
    texts = spread(search_texts(products), "product_id")
    if fuzzy:  # read by several steps, each by as many tasks as there are files
        texts = cut_lineage(texts)
    scores = match_scores(queries, texts)
    if fuzzy:
        scores = scores.unionByName(similarity_scores(queries, texts, limit))
    details = products.select("product_id", *[c for c in ("name", "clean_name", "earliest_date")
                                              if c in products.columns])
    return rank_scores(scores, limit).join(details, "product_id")
