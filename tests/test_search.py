import random
import re

import numpy as np
import pandas as pd
import pytest

from ledgerspark.functions.similarity import full_ratio, partial_ratio, token_set_ratio
from ledgerspark.operators import search


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def windows(short, long):
    n, m = len(long), len(short)
    pieces = {long[max(0, e - m):min(e, n)] for e in range(1, n + m)}
    return max(ratio(short, p) for p in pieces if p)


def partial(a, b):
    if not a or not b:
        return 0.0
    scores = []
    if len(a) <= len(b):
        scores.append(windows(a, b))
    if len(b) <= len(a):
        scores.append(windows(b, a))
    return max(scores)


def token_set(a, b):
    a, b = set(a), set(b)
    if not a or not b:
        return 0.0
    both = " ".join(sorted(a & b))
    if both and (a <= b or b <= a):
        return 100.0
    first, second = ((both + " " + " ".join(sorted(x))).strip() for x in (a - b, b - a))
    scores = [ratio(first, second)]
    if both:
        scores += [ratio(both, first), ratio(both, second)]
    return max(scores)


@pytest.mark.parametrize("seed", range(6))
def test_scores_match_brute_force(seed):
    rng = random.Random(seed)
    # Query lengths around one and two machine words exercise the carry between words.
    size = [3, 9, 63, 64, 65, 140][seed]
    query = "".join(rng.choice("abc é") for _ in range(size)).strip() or "a"
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 90))).strip() for _ in range(25)]
    texts += [query, query[:-1], query + "a", query[::-1]]
    assert full_ratio(query, texts) == pytest.approx([ratio(query, t) for t in texts])
    assert partial_ratio(query, texts) == pytest.approx([partial(query, t) for t in texts])
    words, many = sorted(query.split()), [sorted(t.split()) for t in texts]
    assert token_set_ratio(words, many) == pytest.approx([token_set(words, t) for t in many])


def clean(text, ascii_only=False):
    if ascii_only:
        text = "".join(c for c in text if ord(c) < 128)
    return re.sub(r"\W", " ", text.lower()).strip()


def expected(queries, products, limit, fuzzy=True):
    texts = {}
    for pid, name, other in sorted(products, key=lambda p: (len(p[0]), p[0])):
        texts.setdefault(f"{name} {other or ''}".strip(), pid)
    result = {}
    for qid, q in queries:
        q = q.lower().strip()
        best = {}

        def add(scored, weight):
            for pid, score in scored:
                if score > 25:
                    old = best.get(pid, (0, 0))
                    best[pid] = (max(old[0], score * weight), max(old[1], score))
        add([(p, 100) for t, p in texts.items() if q in t.lower()], 1.2)
        words = q.split()
        add([(p, sum(w in t.lower() for w in words) / len(words) * 90) for t, p in texts.items()], 1.0)
        if fuzzy:
            qs = sorted(clean(q, True).split())
            scorers = [(0.9, lambda t: partial(clean(q), clean(t))),
                       (0.8, lambda t: ratio(" ".join(qs), " ".join(sorted(clean(t, True).split())))),
                       (0.7, lambda t: token_set(qs, clean(t, True).split()))]
            for weight, scorer in scorers:
                ranked = sorted(((scorer(t), p) for t, p in texts.items()), key=lambda x: (-x[0], len(x[1]), x[1]))
                add([(p, round(s)) for s, p in ranked[:3 * limit]], weight)
        order = sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1], len(x[0]), x[0]))[:limit]
        result[qid] = [(p, int(m)) for p, (_, m) in order]
    return result


PRODUCTS = [("10", "Blue Bolt Box", "blue bolt box"), ("9", "Blue Bolt Box", "blue bolt box"),
            ("11", "Red Ring: Elite Trainer", None), ("12", "Hot Ring & Rod", "hot ring rod"),
            ("13", "Poké Ring Tin", "Poke Ring Tin"), ("14", "Anvil", ""), ("15", "Big Anvil 100x", "big"),
            ("16", "old widget", "Old Widget"), ("17", "New widget", "")] + \
           [(str(100 + i), f"set {i} booster {'box' if i % 2 else 'pack'}", f"S{i}") for i in range(30)]
QUERIES = [(1, "blue bolt"), (2, " RING  hot"), (3, "widg"), (4, "booster box s7"), (5, "poké tin"), (6, "zzqq"),
           (7, "anvil the very big one of all the anvils in the shop"), (8, "x"), (9, "   ")]


@pytest.mark.parametrize("fuzzy,limit", [(False, 10), (True, 5), (True, 10)])
def test_search_matches_brute_force(spark, fuzzy, limit):
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    products = spark.createDataFrame(PRODUCTS, "product_id string, name string, clean_name string").repartition(3)
    got = {}
    for r in sorted(search.search_products(queries, products, limit, fuzzy).collect(),
                    key=lambda r: (r.query_id, r.place)):
        got.setdefault(r.query_id, []).append((r.product_id, r.score))
    want = {q: hits for q, hits in expected(QUERIES[:-1], PRODUCTS, limit, fuzzy).items() if hits}
    assert got == want
    assert got[1][0] == ("9", 100)


def test_many_small_cells_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERIES", 3)
    monkeypatch.setattr(search, "TEXTS", 4)
    queries = spark.createDataFrame(QUERIES[:-1], "query_id int, query string")
    products = spark.createDataFrame(PRODUCTS, "product_id string, name string, clean_name string")
    texts = search.search_texts(products)
    cells = sorted(map(tuple, search.similarity_scores(queries, texts, 4).collect()))
    monkeypatch.undo()
    assert cells == sorted(map(tuple, search.similarity_scores(queries, texts, 4).collect()))


def test_bounds_are_never_below_a_score():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcde é_1") for _ in range(rng.randint(0, 40))).strip() for _ in range(200)] + ["", "a", "abc" * 90]
    cell = search._Cell(pd.DataFrame({"plain": texts, "words": [sorted(t.split()) for t in texts], "id_length": 1, "product_id": [f"{i:03}" for i in range(len(texts))]}))
    for _ in range(20):
        plain = "".join(rng.choice("abcde é") for _ in range(rng.randint(1, 70))).strip() or "b"
        query = pd.DataFrame({"plain": [plain], "words": [sorted(plain.split())]}).itertuples().__next__()
        for scorer, bounds in cell.bounds(query).items():
            scores = cell.scores(scorer, query, np.arange(len(texts)))
            assert (bounds >= scores - 1e-9).all(), scorer
            # Stopping early keeps the best texts, ties included.
            kept, best, _ = cell.best(scorer, query, bounds, 25.5, 10)
            want = sorted((-s, i) for i, s in enumerate(scores) if s >= 25.5)[:10]
            # The cell sorts its texts by id; here all ids are equal and the order stays.
            assert list(zip((-best).tolist(), kept.tolist())) == want


def test_few_texts_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(search, "TEXTS", 120)
    monkeypatch.setattr(search, "OPENED", 16)
    rng = random.Random(8)
    # Twenty kinds of names in thirty variants each: a search for one kind need not open the others.
    kinds = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèàçñøå") for _ in range(6)) for _ in range(4)) for _ in range(20)]
    names = [(str(i), f"{kinds[i % 20]} {i // 20}", None) for i in range(600)]
    products = spark.createDataFrame(names, "product_id string, name string, clean_name string")
    queries = spark.createDataFrame([(i, kinds[i][1:22]) for i in range(6)], "query_id int, query string")
    shares = {r.scorer: r.compared / r.pairs for r in search.compared_shares(queries, search.search_texts(products), 1).collect()}
    assert set(shares) == set(search.SIMILAR) and all(0 < s < 0.6 for s in shares.values()), shares


def test_words_are_looked_up_by_their_rarest_piece(spark):
    products = spark.createDataFrame([(str(i), f"aaa{'b' if i == 7 else ''} common {i}", "") for i in range(50)],
                                     "product_id string, name string, clean_name string")
    texts = search.search_texts(products)
    queries = spark.createDataFrame([(1, "AAAB"), (2, "aaaz"), (3, "aa 7"), (4, "common 12"), (5, "mmon 3")], "query_id int, query string")
    stored = search.gram_index(texts).cache()
    assert "text" not in stored.columns
    # The word of the first query has pieces that all texts have; the rarest one only one has.
    words = spark.createDataFrame([("aaab",), ("aaaz",), ("aa",)], "word string")
    able = search._rarest_pieces(words, stored)
    assert sorted({r.product_id for r in able.filter("word = 'aaab'").collect()}) == ["7"]
    assert able.filter("word = 'aaaz'").count() == 0 and able.filter("word = 'aa'").count() == 50
    with_index = sorted(map(tuple, search.match_scores(queries, texts, stored).collect()))
    assert with_index == sorted(map(tuple, search.match_scores(queries, texts).collect()))
    whole = {(r[0], r[3]) for r in with_index if r[1] == "exact"}
    assert whole == {(1, "7"), (4, "12"), *((5, str(i)) for i in (3, *range(30, 40)))}
