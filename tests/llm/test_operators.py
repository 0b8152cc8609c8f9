import collections
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerspark.llm import decontaminate, html, language, mixing, paragraphs, quality, secrets, simhash, tokens, warc
from ledgerspark.llm.common import components, prefix_sums

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
# Nulls, empty and blank texts, ties, repeated rows and a very long text.
ODD = [(None, "null id text here with words", "en", None, 1), (1, None, None, "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", "b", 3),
       (4, "same text of five words", "en", "b", 5), (4, "same text of five words", "en", "b", 5), (5, "same text of five words", None, "a", 5),
       (6, "lang " * 50_000, "en", "a", 5), (7, "漢字 😀 é ñ <|endoftext|>", "xx", "c", 9)]


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    # An extra column clashes with names that operators add.
    return spark.createDataFrame(ODD, DOC).withColumn("size", F.lit("x")).withColumn("kept", F.lit(9))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_prefix_sums_and_components(spark):
    rng = random.Random(1)
    data = [("h" if rng.random() < 0.8 else "k", i, rng.randint(0, 9)) for i in range(300)]
    got = {r["i"]: r["s"] for r in prefix_sums(spark.createDataFrame(data, "g string, i long, v long"), "g", ["i"], "v", "s").collect()}
    for g in "hk":
        total = 0
        for _, i, v in sorted(d for d in data if d[0] == g):
            assert got[i] == total
            total += v
    edges = [(i, i + 1) for i in range(40) if i % 9] + [(100, 40), (7, 7)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in parent:
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert dict(rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "root")) == parent
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mix(spark, odd, empty):
    assert mixing.mix(empty).count() == 0
    got = mixing.mix(odd)
    assert dict(got.dtypes)["size"] == "bigint" and got.count() == len(ODD)
    taken = collections.defaultdict(int)
    for r in got.collect():
        taken[r["source"], r["target"], r["source_size"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(t - 2 <= n <= t for (_, t, _), n in taken.items())
    assert math.isclose(sum(t for _, t, _ in taken), 1.5 * sum(s for _, _, s in taken))
    assert rows(mixing.mix(odd), "doc_id", "taken") == rows(got, "doc_id", "taken")
    words = {}
    for r in mixing.emit(got).collect():
        key = r["doc_id"], r["source"]
        words[key] = words.get(key, 0) + len(r["text"].encode().split())
    assert words == {k: n for k, n in {(r["doc_id"], r["source"]): sum(x["taken"] for x in got.collect() if (x["doc_id"], x["source"]) == (r["doc_id"], r["source"]))
                                       for r in got.collect()}.items() if n}


def test_html_blocks_and_noise():
    page = """<!doctype html><html><head><title>T</title><script>var x = "</p>";</script></head><body class="a">
      <header><a href="/">Site</a></header><nav>Menu</nav><div class="cookie-notice">We use</div>
      <article><header><h1>Head &amp; line</h1></header><p>One <b>two</b><br>three&nbsp;four<p>Five
      <ul><li>six<li>seven</ul><div class="ad">Buy</div><form>Name</form><!-- <p>no</p> --><section class="comments"><p>I disagree</p></section>
      <table><tr><td>a</td><td>b</td></tr></table><style>p{}</style></article><aside>Side</aside><footer>&copy; x</footer></body>"""
    assert html.text_of(page) == "Head & line\n\nOne two three four\n\nFive\n\nsix\n\nseven\n\na b"
    assert html.text_of("") == "" and html.text_of("<p>a &lt;b&gt; <b>c") == "a <b> c"
    assert html.text_of("plain <!-- open") == "plain" and html.text_of("<" * 2000 + "a") != ""


def test_style_tree_removes_what_pages_share(spark):
    rng = random.Random(2)
    # No element or class tells the box from the text; only the site does.
    made = [(i, f"http://h.example/{i}", f"<body><div class=x1>Same words on every page</div><div class=x2><p>{prose(rng, 30)}</p></div></body>")
            for i in range(30)]
    made += [(90, None, None), (91, "http://one.example/", "<body><div class=x1>Alone</div></body>"), (92, "no url", "")]
    pages = spark.createDataFrame(made, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(pages).collect()}
    for i, _, page in made[:30]:
        text = re.search("<p>(.*)</p>", page)[1]
        assert got[i] == (text, len(text))
    assert got[90] == ("", 0) and got[91][0] == "Alone" and got[92] == ("", 0)
    assert html.extract(pages.limit(0)).count() == 0


def test_style_tree_of_rare_nodes(spark):
    rng = random.Random(14)
    page = "<body><div class=x2><p>{}</p></div>{}</body>"
    # A box on 10 of 400 pages of a host goes as it does on 10 of 20; a branch that holds a rare text stays.
    box = "<div class=x5>Same words of one section</div>"
    made = [(i, f"http://big.example/{i}", page.format(prose(rng, 30), box if i < 10 else "")) for i in range(400)]
    made += [(i, f"http://small.example/{i}", page.format(prose(rng, 30), box if i < 510 else "")) for i in range(500, 520)]
    rare = {i: prose(rng, 30) for i in range(600, 603)}
    made += [(i, f"http://rare.example/{i}", page.format(prose(rng, 30), f"<div class=x7>Same words<div class=x8>{rare.get(i, '')}</div></div>"))
             for i in range(600, 630)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert not any("Same words of" in x for x in got.values()) and len(got) == 450
    assert all(rare[i] in got[i] for i in rare)
    assert all(re.search("<p>(.*?)</p>", x)[1] in got[i] for i, _, x in made)


def test_paragraphs(spark, odd, empty):
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(6)]
    texts = []
    for i in range(60):
        w = base[i % 6].split()
        if i >= 12:
            w[rng.randrange(60)] = f"w{i}"
        texts.append((i, prose(rng, 50) + "\n" + " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs = spark.createDataFrame([*texts, (None, base[0]), (3, texts[3][1])], "doc_id long, text string")
    found = paragraphs.find(docs)
    lines = [(d, n, x) for d, t in texts for n, x in enumerate(t.split("\n"))]
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (re.findall(r"\w+", x.lower()) for _, _, x in lines)]
    root = list(range(len(lines)))
    for _ in range(len(lines)):
        for i in range(len(lines)):
            for j in range(i):
                if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
    groups = collections.defaultdict(list)
    for (d, n, _), r in zip(lines, root, strict=True):
        groups[r].append((d, n))
    want = {(d, n, min(g)[0], (d, n) != min(g)) for g in groups.values() if len(g) > 1 for d, n in g}
    got = {(r["doc_id"], r["para_no"], r["cluster_id"], r["removed"]) for r in found.where("doc_id is not null").collect()}
    assert got == want
    assert [r["removed"] for r in found.where("doc_id is null").collect()] == [True]
    left = paragraphs.remove(docs, found)
    assert left.count() == docs.count() and left.where("doc_id = 30").first()[1] == texts[30][1].split("\n")[0]
    assert paragraphs.find(empty).count() == 0 and paragraphs.find(odd, min_words=3).where("removed").count() == 1


def test_short_lines_are_paragraphs(spark):
    rng = random.Random(12)
    wrapped = "\n".join(prose(rng, n) for n in (7, 25, 25, 3, 4))
    made = [(2, wrapped), (467, prose(rng, 40) + "\n" + wrapped), (5, "* * *"), (6, "- - -"), (7, "- - -"), (8, "Yes, one!"), (9, "yes one")]
    found = paragraphs.find(spark.createDataFrame(made, "doc_id long, text string"))
    want = [(2, n, 2, False) for n in range(5)] + [(467, n + 1, 2, True) for n in range(5)]
    want += [(6, 0, 6, False), (7, 0, 6, True), (8, 0, 8, False), (9, 0, 8, True)]
    assert rows(found, "doc_id", "para_no", "cluster_id", "removed") == sorted(want, key=repr)


def test_passages_inside_lines_and_over_breaks(spark):
    rng = random.Random(13)
    run = [f"{w}{k}" for k, w in enumerate(prose(rng, 50).split())]
    texts = {}
    for i in range(12):
        words = [f"p{i}x{k}" for k in range(40)] + run + [f"s{i}x{k}" for k in range(40)]
        breaks = set(rng.sample(range(1, 130), i))
        texts[i] = "".join(("\n" if k in breaks else " " if k else "") + w for k, w in enumerate(words))
    texts[20] = " ".join(f"alone{k}" for k in range(200)) + " lang" * 300
    docs = spark.createDataFrame([*texts.items(), (0, texts[0])], "doc_id long, text string")
    found = paragraphs.find(docs)
    got = found.where("word_no is not null").collect()
    assert {r["doc_id"] for r in got} == set(range(12)) and all(r["cluster_id"] in range(12) for r in got)
    assert all(r["removed"] == (r["doc_id"] != r["cluster_id"]) for r in got)
    assert all(texts[r["doc_id"]].split()[r["word_no"]:r["word_no"] + 25] == run[r["word_no"] - 40:r["word_no"] - 15]
               and 40 <= r["word_no"] <= 65 for r in got)
    left = {r["doc_id"]: r["text"] for r in paragraphs.remove(docs, found).collect()}
    assert left[0] == texts[0] and left[20] == texts[20]
    for i in range(1, 12):
        words = left[i].split()
        assert len(words) <= 105 and [w for w in words if w not in run] == [w for w in texts[i].split() if w not in run]


def test_residual_links_between_bucket_members(spark):
    w = [f"a{i}" for i in range(100)]
    chain = [w[k * 4:k * 4 + 60] for k in range(6)]  # neighbours are alike, the ends are not
    sets = [(i, [hash(tuple(c[k:k + 5])) for k in range(56)]) for i, c in enumerate(chain)]
    rest = spark.createDataFrame([(1, i, i, 6) for i in range(6)], "band long, key long, part long, n long")
    got = components(paragraphs._residual(rest, spark.createDataFrame(sets, "key long, shingles array<long>"), 0.8))
    assert {r["root"] for r in got.collect()} == {0} and got.count() == 6


def test_secrets(spark, odd, empty):
    rng = random.Random(4)
    code = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    planted = {i: code(40) for i in range(0, 40, 2)}
    made = [(i, f"some words before token = \"{planted[i]}\" and after" if i in planted else
             f"order {rng.randrange(10 ** 15, 10 ** 16)} and /usr/share/some0/path/file-name-12 here") for i in range(40)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    found = secrets.scan(docs)
    assert {(r["doc_id"], r["found"]) for r in found.where("is_secret").collect()} == set(planted.items())
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, found).collect()}
    assert clean == {i: t.replace(planted.get(i, "\0"), "[SECRET]") for i, t in made}
    assert secrets.scan(empty).count() == 0 and secrets.scan(odd).count() == 0
    assert secrets.redact(odd, secrets.scan(odd)).count() == len(ODD)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_secrets_of_other_forms(spark):
    rng = random.Random(15)
    letters = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    forms = ['password = "{}"', "password: {}", "DB_PASSWORD='{}'", 'secret="{}"']
    values = ["hunter2secret", "KQZXWVJPRTLMBNGH", "p.4!x@Z:q9", "Zq7\\E.$1k", *(letters(rng.randint(6, 20)) for _ in range(36))]
    made = [(i, f"some words before {forms[i % 4].format(v)} and after the token of the key words") for i, v in enumerate(values)]
    made += [(i, f"order {rng.randrange(10 ** 15, 10 ** 16)} and some words before and after the token of the key words") for i in range(50, 90)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    found = secrets.scan(docs)
    assert {(r["doc_id"], r["found"]) for r in found.where("is_secret").collect()} == set(enumerate(values))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, found).collect()}
    assert clean == {i: t.replace(values[i], "[SECRET]") if i < 50 else t for i, t in made}
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_decontamination(spark, odd, empty):
    rng = random.Random(5)
    items = [(i, prose(rng, 12 + i) + ". " + prose(rng, 8) + ".") for i in range(40)] + [(90, None), (91, ""), (None, prose(rng, 20)), (92, "two words")]
    docs = []
    for i in range(120):
        text = prose(rng, 200).split()
        if i % 3 == 0:
            text[100:100] = items[i // 3][1].upper().split()
        docs.append((i, " ".join(text)))
    made = spark.createDataFrame([*docs, (None, items[4][1]), (500, None), (501, "Two, WORDS!")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: " " + " ".join(decontaminate.words(t)) + " "
    want = {(d, i) for d, t in [*docs, (None, items[4][1]), (501, "Two, WORDS!")] for i, x in items if i is not None and x and norm(x) in norm(t)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(made, bench).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(made, bench, most=400).collect()} == want
    assert decontaminate.clean(made, bench).count() == made.count() - len({d for d, _ in want})
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.clean(odd, bench.limit(0)).count() == len(ODD)


def brute_repeats(words):
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    n = collections.Counter(windows)
    return len({k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)})


def test_quality_counts_and_rules(spark, odd, empty):
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", " ", "\n", "#", "<", "é ", "x y z "]) for _ in range(rng.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality.count(text)[:5] == (len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")),
                                           len(lines) - len(set(lines)), brute_repeats(words))
    docs = [(i, prose(rng, 80) if i % 4 else " ".join(w + "###" for w in prose(rng, 80).split())) for i in range(400)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(0, 400, 2)] + [(None, 0, 0), (3, None, 0), (2, 0, 0)]
    made = spark.createDataFrame(docs, "doc_id long, text string")
    judged = quality.judge(made, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in judged.collect())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(odd, none)
    assert got.count() == len(ODD) and {r["kept"] for r in got.collect()} == {False} and quality.judge(empty, none).count() == 0


def test_simhash_against_all_pairs(spark, odd, empty):
    rng = random.Random(7)
    made = []
    base = [prose(rng, 300) for _ in range(20)]
    for i in range(400):
        w = base[i % 20].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(300)] = "new"
        made.append((i, " ".join(w)))
    docs = spark.createDataFrame([*made, *((r[0], r[1]) for r in ODD)], "doc_id long, text string")

    def brute(text):
        w = [x.decode() for x in (text or "").encode().lower().split()]
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    every = [(d, brute(t)) for d, t in [*made, *((r[0], r[1]) for r in ODD)]]
    fp = np.array([f for _, f in every], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    root = np.arange(len(every))
    while True:
        low = np.where(near, root[None, :], len(every)).min(1)
        if (low == root).all():
            break
        root = low
    first = {}
    for (d, _), r in zip(every, root, strict=True):
        if d is not None:
            first[r] = min(d, first.get(r, d))
    want = sorted(((d, f"{f:016x}", first.get(r)) for (d, f), r in zip(every, root.tolist(), strict=True)), key=repr)
    assert rows(simhash.link(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs)
    assert kept.count() == len(set(root.tolist())) and kept.columns == docs.columns
    assert simhash.link(empty).count() == 0 and simhash.keep_one(empty).count() == 0 and simhash.keep_one(odd).columns == odd.columns


def test_gray_tree_finds_links_across_slices():
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp ^ np.uint64(1 << k) for k in range(8)] + [fp]))
    tree = simhash._Group(fp, 3)
    tree.within(0, len(fp))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    assert ((tree.part[:, None] == tree.part[None, :]) >= near).all() and len(tree.edges) == len(fp) - len(np.unique(tree.part))


def test_warc_audit(spark):
    made = [(i, f"http://x/{i % 7}", f"<p>{'y' * (i * 37 % 900)}</p>" if i % 50 else None) for i in range(300)] + [(None, None, "n"), (None, None, "n")]
    ours = spark.createDataFrame(made, "page_id long, url string, html string")
    small = {"file_bytes": 20_000, "range_bytes": 2_000}
    assert warc.audit(ours, ours, **small).count() == 0 and warc.audit(ours.limit(0), ours.limit(0)).count() == 0
    other = [(i, u, (h or "") + "!" if i in (5, 50) else h) for i, u, h in made if i not in (7, 8)] + [(900, "http://new", "z"), made[20]]
    found = warc.audit(ours, spark.createDataFrame(other, ours.schema), **small)
    assert rows(found, "page_id", "kind", "copies") == sorted(
        [(5, "changed", 1), (50, "changed", 1), (7, "missing", 1), (8, "missing", 1), (900, "extra", 1), (20, "copies", 1)], key=repr)
    assert rows(warc.audit(ours, ours.limit(0), **small), "kind") == [("missing",)] * 301


def test_token_prefixes(spark, odd, empty):
    from tokenizers import Tokenizer
    library, counter = Tokenizer.from_file(BPE), tokens.PrefixCounter(BPE)
    rng = random.Random(9)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "'", "!!", "<|endoftext|>", "<|", "é", "漢字", "😀", "12", "\xa0", "\r\n", "-", "aaaa"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert counter.counts(text) == [len(library.encode(text[:k + 1], add_special_tokens=False).ids) for k in range(len(text))], text
    got = tokens.truncate(tokens.over_limit(tokens.token_prefixes(odd, BPE), 4), 4)
    want = []
    for d, t, *_ in ODD:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 4))
    assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert {r["n_chars"] for r in got.where("doc_id = 4").collect()} == {len("same text of five")}
    assert tokens.token_prefixes(empty, BPE).count() == 0


def test_language(spark, odd, empty):
    rng = random.Random(10)
    sound = {"aa": ["the", "and", "ing", "er", "wh"], "bb": ["der", "sch", "ung", "ein", "zu"]}
    made = [(i, " ".join("".join(rng.choice(sound[k]) for _ in range(3)) for _ in range(20)), k) for i in range(300) for k in [rng.choice(["aa", "bb"])]]
    docs = spark.createDataFrame([*made, (900, "1234 !! ½ ² ① Ⅷ", "aa"), (901, None, "bb"), (None, "the", "aa"), (902, "x" * 5000, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs, PIECES).collect()}
    assert len(got) == 304 and got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[901]["score"] == 0.0
    for i, _, lang in made:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i]["lang_pred"] == lang
        assert 0 <= got[i]["score"] <= 1
    assert not got[None]["held_out"]
    assert language.identify(odd, PIECES).count() == len(ODD) and language.identify(empty, PIECES).count() == 0
    model = language.Model(["p"], {"▁a": [0.2], "b": [0.1], "▁ab": [0.05], "a": [0.3]}, 3)
    segmentations = 0.05 + 0.2 * (0.1 + language.FLOOR) + language.FLOOR * (0.3 + language.FLOOR) * (0.1 + language.FLOOR)
    model.learn({"▁ab"})
    assert math.isclose(math.exp(model.scores[0][0]), segmentations, rel_tol=1e-9)


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, folder))
        assert docs.columns == before.columns and docs.count() <= before.count(), name
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert docs.where(F.lower("text").rlike('token = "[0-9a-f]{40}"')).count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert set(docs.columns) <= set(mixed.columns) and 0 < mixed.count() <= 2 * docs.count()
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"


def test_joined_paragraphs_hold_every_word_once(spark):
    rng = random.Random(21)
    for _ in range(200):
        lines = [prose(rng, rng.choice([0, 1, 3, 8, 29, 30, 45])) for _ in range(rng.randint(0, 12))]
        text = "\n".join(lines)
        parts = paragraphs.joined(text, 30)
        covered = [line for first, n, _, _ in parts for line in lines[first:first + n]]
        assert " ".join(" ".join(covered).split()) == " ".join(text.split())
        assert all(words == len(body.split()) for _, _, words, body in parts)
        assert len(parts) <= 1 or all(words >= 30 for _, _, words, _ in parts)
    shared, heading = "\n".join(prose(rng, 12) for _ in range(4)), "Chapter one"
    made = [(i, f"{heading}\n{prose(rng, 60)}\nYes, said the other.\n{prose(rng, 50)}") for i in range(8)]
    made += [(10, prose(rng, 33) + "\n" + shared), (11, prose(rng, 31) + "\n" + shared), (12, "short text of six words here"), (13, "short text of six words here")]
    found = paragraphs.find(spark.createDataFrame(made, "doc_id long, text string"), min_words=30)
    # A heading or a line of talk that many texts share stays where it is; lines that repeat together go together.
    assert rows(found, "doc_id", "para_no", "n_lines", "removed") == [
        (10, 1, 4, False), (11, 1, 4, True), (12, 0, 1, False), (13, 0, 1, True)]
    left = {r["doc_id"]: r["text"] for r in paragraphs.remove(spark.createDataFrame(made, "doc_id long, text string"), found).collect()}
    assert left == {d: t for d, t in made} | {11: made[9][1].split("\n")[0], 13: ""}


FRAMES = ("content has-sidebar", "no-sidebar", "layout-sidebar-right", "nav-open wrapper", "page-with-comments", "related-work", "search-results",
          "share-price", "alert-body", "widget-free", "menu-closed", "ad-free", "article-social", "top")


@pytest.mark.parametrize("frame", FRAMES)
def test_marks_on_frames_do_not_empty_a_page(frame):
    rng = random.Random(5)
    body, side = prose(rng, 80), prose(rng, 12)
    page = f'<div class="{frame}"><h1>Title</h1><p>{body}</p><div class="sidebar">{side}</div></div>'
    assert html.text_of(page) == f"Title\n\n{body}"
    assert html.text_of(f"<main>{page}</main>") == f"Title\n\n{body}"
    # A marked branch beside the article goes, however long it is.
    assert html.text_of(f'<p>{body}</p><div class="comments">{prose(rng, 120)}</div>') == body


def test_long_and_broken_pages_are_read_once():
    began = time.perf_counter()
    for part in ("<div ", "<a href=\"", "<a x='\" ", "<!--", "<script ", "<", "</", "<p class=a", "<b><i "):
        html.text_of(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 30
    assert html.text_of("<p>one</p><p>two</p><!-- never closed <p>three") == "one\n\ntwo"
    teaser = "<article><p>Teaser only.</p></article>"
    body = prose(random.Random(1), 60)
    assert html.text_of(f"{teaser}<div><p>{body}</p></div>") == f"Teaser only.\n\n{body}"
    assert html.text_of(f"<article><p>{body}</p></article><div><p>Next page</p></div>") == body
