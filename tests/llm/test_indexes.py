"""Cuckoo index, hash-state tree and vector codes against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import exact, manifest, sha256, vector_codes

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "Null id", "en", None, 1), (1, None, None, "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", "b", 3),
       (4, "Same TEXT of five words", "en", "b", 5), (4, "Same TEXT of five words", "en", "b", 5), (2 ** 53 + 1, "same text of five words", None, "a", 5),
       (4, "same text of five words", "en", "b", None), (6, "Lang " * 50_000, "", "a", 5), (7, "ÄÖ 漢字 😀 É <|x|>", "xx", "c", 9),
       (8, "äö 漢字 😀 É <|X|>", "xx", "c", 9), (9, None, "en", None, None), (None, None, None, None, None)]


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    more = [(i, rng.choice(["Aa", "aA", "b", "c " * 40, None, f"T{i}"]), rng.choice(["en", "en", "en", "de", None]), "s", 1) for i in range(20, 220)]
    # Extra columns clash with names that the operators use.
    return (spark.createDataFrame([*ODD, *more], DOC).repartition(6)
            .withColumns({c: F.lit("x") for c in ("digest", "lead", "size", "i", "grp", "replaced", "one", "kept", "row_no", "shard", "chunk")}))


def test_states_are_those_of_the_standard():
    for n in (1, 5, 300):
        messages = [[hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(3)] for i in range(n)]
        state = sha256.fresh(n)
        for k in range(3):
            state = sha256.fed(state, sha256.hex_blocks(sha256.from_bytes(b"".join(bytes.fromhex(m[k]) for m in messages))))
        got = sha256.to_bytes(sha256.ended(state, np.full(n, 3, dtype=np.uint32)))
        assert got == b"".join(hashlib.sha256("".join(m).encode()).digest() for m in messages)


def tree_by_hand(leaves):
    """Levels of hex digests from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([hashlib.sha256("".join(now[k:k + 8]).encode()).hexdigest() for k in range(0, len(now), 8)])
    return levels


def climb(levels, i, digest):
    proof = ""
    for level in levels[:-1]:
        run = level[i // 8 * 8:i // 8 * 8 + 8]
        proof += "".join(h for k, h in enumerate(run) if k != i % 8)
        digest = hashlib.sha256("".join(digest if k == i % 8 else h for k, h in enumerate(run)).encode()).hexdigest()
        i //= 8
    return proof, digest


def audited(data):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, la, s, n: hashlib.sha256("".join(map(frame, (d, s, la, n, t))).encode()).hexdigest()
    groups = {}
    for d, t, la, s, n in data:
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        low = leaf(d, None if t is None else ascii_lower(t), la, s, n)
        groups.setdefault(la, []).append((d is not None, d or 0, leaf(d, t, la, s, n), low if hit else None))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_by_hand([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree_by_hand([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (known, d, h, low) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            proof, now = climb(trees[g], i, low or h)
            more, now = climb(top, k, now)
            out.append((d if known else None, h, trees[g][-1][0], top[-1][0], hashlib.sha256((proof + more).encode()).hexdigest(), now, now == top[-1][0]))
    return sorted(out, key=repr)


NAMES = "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"


@pytest.mark.parametrize("levels", [1, 4])
def test_manifest_is_that_of_one_tree(spark, docs, levels, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    data = [tuple(r)[:5] for r in docs.collect()]
    assert rows(manifest.audit(docs), *NAMES) == audited(data)


def test_manifest_of_many_langs_and_of_none(spark):
    many = [(i, f"T {i}", f"l{i % 75}", None, i) for i in range(160)]
    assert rows(manifest.audit(spark.createDataFrame(many, DOC)), *NAMES) == audited(many)
    assert rows(manifest.audit(spark.createDataFrame(many[:1], DOC)), *NAMES) == audited(many[:1])
    none = manifest.audit(spark.createDataFrame([], DOC))
    assert none.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and none.count() == 0


def test_fold_resumes_kept_states():
    """Replacing one child gives the parent that hashing the whole run gives, whatever stands to its left."""
    rng = np.random.default_rng(1)
    nodes = rng.integers(0, 2 ** 32, (8, 21), dtype=np.uint32)
    new = rng.integers(0, 2 ** 32, (8, 21), dtype=np.uint32)
    parents, kept = manifest.parents_of(nodes)
    folded = manifest.resumed(new, np.arange(21), nodes, kept)
    for i in range(21):
        changed = nodes.copy()
        changed[:, i] = new[:, i]
        assert (manifest.parents_of(changed)[0][:, i // 8] == folded[:, i]).all()
    assert (manifest.resumed(nodes, np.arange(21), nodes, kept) == parents[:, np.arange(21) // 8]).all()


def test_cuckoo_index_is_a_dictionary():
    rng = random.Random(4)
    index, live = exact.CuckooIndex(1), {}
    # Few different marks and buckets: most hits of the filter are false and the digest has to decide.
    digests = [bytes([0] * 7 + [rng.randrange(64)]) + bytes([0, 1 + rng.randrange(2)]) + i.to_bytes(22, "big") for i in range(300)]
    digests += [rng.randbytes(32) for _ in range(1500)]
    for step in range(20_000):
        digest = rng.choice(digests)
        assert (index.find(digest) >= 0) == (digest in live)
        if digest in live and rng.random() < 0.6:
            assert index.delete(digest) and not index.delete(digest)
            del live[digest]
        elif digest not in live:
            index.insert(digest, step)
            live[digest] = step
    assert {d: v for d, v in zip(index.digests, index.values) if d is not None} == live
    assert all(index.values[index.find(d)] == v for d, v in live.items())
    assert index.buckets > 64 and sum(m > 0 for m in index.marks) == len(live)


def grouped(data):
    groups = {}
    for d, t, *_ in data:
        groups.setdefault(ascii_lower(t or ""), []).append(d)
    most = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return groups, most


@pytest.mark.parametrize("block, shard", [(7, 5), (1 << 17, 1 << 14)])
def test_dedup_is_that_of_a_dictionary(spark, docs, block, shard, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK", block)
    monkeypatch.setattr(exact, "SHARD", shard)
    data = [tuple(r)[:5] for r in docs.collect()]
    groups, most = grouped(data)
    got = exact.dedup(docs)
    text = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(
        ((d, most[t], len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids), key=repr)
    kept = rows(got.where("kept"), "text_sha256", "doc_id")
    assert kept == sorted(((h, most[t]) for h, t in text.items()), key=repr)
    assert exact.dedup(docs.limit(0)).count() == 0


def test_index_takes_later_rows_and_deletions(spark, docs):
    data = [tuple(r)[:5] for r in docs.collect()]
    old, new = (spark.createDataFrame([r for r in data if (r[0] or 0) % 2 == k], DOC) for k in (0, 1))
    gone = spark.createDataFrame([(None, "AA", "en", None, 0), (None, "not there", "en", None, 0), (None, None, None, None, None)], DOC)
    index = exact.Index.empty(spark, 10).insert(exact.digested(old)).insert(exact.digested(new))
    groups, most = grouped(data)
    digest = {hashlib.sha256(t.encode()).digest(): t for t in groups}
    assert {digest[bytes(r["digest"])]: (r["doc_id"], r["group_size"]) for r in index.rows.collect()} == {
        t: (most[t], len(ids)) for t, ids in groups.items()}
    index = index.delete(exact.digested(gone))
    assert {digest[bytes(r["digest"])] for r in index.rows.collect()} == set(groups) - {"aa", ""}
    again = index.insert(exact.digested(gone.limit(1)))
    found = again.matches(exact.digested(spark.createDataFrame([(5, "aA", "", "", 0), (6, "", "", "", 0)], DOC)))
    assert rows(found, "doc_id", "keep_id", "group_size") == [(5, None, 1), (6, None, None)]


VECTOR = "vec_id long, embedding array<float>, label int"


def codes_by_hand(x, entries, rounds):
    """Codes, errors and books of the integer vectors ``x``, rows in order of their ids."""
    size = x.shape[1] // 4
    parts = [x[:, p * size:(p + 1) * size] for p in range(4)]
    books = [p[:entries].copy() for p in parts]

    def assigned(p):
        distances = ((parts[p][:, None, :] - books[p][None]) ** 2).sum(axis=2)
        return distances.argmin(axis=1), distances.min(axis=1)

    for _ in range(rounds):
        for p in range(4):
            best = assigned(p)[0]
            for k in set(best.tolist()):
                mine = parts[p][best == k]
                books[p][k] = mine.sum(axis=0) // len(mine)
    found = [assigned(p) for p in range(4)]
    return np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found), np.stack(books)


@pytest.mark.parametrize("spread, block", [(1.0, 8), (1.0, 256), (20_000.0, 16)])
def test_codes_are_those_of_all_distances(spark, spread, block, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(9, 12)) * spread
    made = (centres[rng.integers(0, 9, 300)] + rng.normal(size=(300, 12)) * spread * 0.05).astype(np.float32)
    made[200:] = made[7]  # a third of all vectors are the same
    table = [(int(i), made[i].tolist(), int(i) % 3 or None) for i in rng.permutation(300)]
    bad = [(400, None, 1), (401, [1.0, None, *[0.0] * 10], 1), (402, [float("nan")] * 12, 1), (403, [float("-inf")] * 12, None)]
    df = spark.createDataFrame([*table, *bad], VECTOR).repartition(5).withColumn("part", F.lit("x")).withColumn("x", F.lit(0)).withColumn("row_no", F.lit(1))
    coded, books = vector_codes.compress(df, entries=20)
    codes, errors, want = codes_by_hand(np.floor(made.astype(np.float64) * 1024).astype(np.int64), 20, 4)
    assert (books == want).all()
    assert rows(coded, "vec_id", "codes", "error") == sorted([(i, codes[i].tolist(), int(errors[i])) for i in range(300)], key=repr)
    got = vector_codes.report(df)
    by_label = {}
    for r in got.join(df.select("vec_id", "label"), "vec_id").collect():
        by_label.setdefault(r["label"], []).append((r["error"], r["label_error"]))
    assert set(by_label) == {None, 1, 2} and all({t for _, t in v} == {sum(e for e, _ in v)} for v in by_label.values())


def test_codes_of_odd_vectors(spark):
    none = spark.createDataFrame([], VECTOR)
    assert vector_codes.report(none).count() == 0 and vector_codes.compress(none)[1].shape[1] == 0
    odd = spark.createDataFrame([(None, [1.0] * 5, 1), (3, [2.0], 1), (3, [2.0], 1), (2, [], None), (1, [3e38] * 8, None), (1, [-3e38] * 8, None)], VECTOR)
    got = vector_codes.report(odd)
    assert got.count() == 6 and rows(got.select("error").distinct(), "error") == [(0,)]
    # Entries 0 and 1 are the rows of id 1, the smaller vector first; zeros fill up what is missing.
    assert rows(got.where("vec_id <= 2"), "vec_id", "code") == [(1, "00000000"), (1, "01010101"), (2, "02020202")]


def test_curve_steps_between_neighbours_and_boxes_keep_the_nearest():
    for d, bits in ((2, 3), (3, 2), (4, 1)):
        points = np.array(np.meshgrid(*[range(1 << bits)] * d)).reshape(d, -1).T
        keys = vector_codes.hilbert_keys(points, bits)
        walk = points[sorted(range(len(points)), key=lambda i: keys[i])]
        assert len(set(keys)) == len(points) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, entries = rng.integers(-9, 9, (6, 3)) + rng.integers(-20, 20, 3), rng.integers(-20, 20, (30, 3))
        able = vector_codes.shortlist(x.min(axis=0), x.max(axis=0), entries)
        distances = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert set(distances.argmin(axis=1)) <= set(able.tolist())
        best, least = vector_codes.nearest(x, entries[able])
        assert (able[best] == distances.argmin(axis=1)).all() and (least == distances.min(axis=1)).all()
