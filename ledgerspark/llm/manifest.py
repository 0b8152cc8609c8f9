"""Merkle manifest of a dataset whose parents keep the hash states before each child slot.

A parent hashes the hex digests of up to 8 children, one SHA-256 block each, and keeps a copy of the
state before every child. To replace a child, the state before it is resumed with the new digest
and the siblings to its right; nothing to its left is hashed again.

The trees are cut into subtrees of four levels (4,096 nodes at the bottom). A subtree is one row of a
stored table, so tasks stay small at every size and a group that holds most rows is spread over as
many tasks as it has subtrees. What a leaf needs from above, its path, is the same for its whole subtree
and travels once per subtree.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm import sha256
from ledgerspark.llm.common import prefix_sums, stored

FANOUT = 8
LEVELS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SUBTREE = "grp string, chunk long, digest binary, levels array<binary>, states array<binary>"
_STEPS = "befores array<binary>, lefts array<binary>, rights array<binary>"


def lowered(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is.

    Where all characters are ASCII, Spark's much faster ``lower`` does the same.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (binary) over the fields, each ``-`` if null, else its number of bytes, ``:`` and its text."""
    def framed(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[framed(f) for f in fields]), 256))


def parents_of(children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests (8, m) of the parents of the nodes (8, n) in runs of 8, and the states (8 slots, 8, m) they keep."""
    n = children.shape[1]
    m = -(-n // FANOUT)
    blocks, state = sha256.hex_blocks(children), sha256.fresh(m)
    kept = np.zeros((FANOUT, sha256.WORDS, m), dtype=np.uint32)
    for slot in range(FANOUT):
        kept[slot] = state
        here = blocks[:, slot::FANOUT]  # only the last run may end before this slot
        state = state.copy()
        if here.shape[1]:
            state[:, :here.shape[1]] = sha256.fed(state[:, :here.shape[1]], here)
    return sha256.ended(state, _run_sizes(n)), kept


def _run_sizes(n: int) -> np.ndarray:
    sizes = np.full(-(-n // FANOUT), FANOUT, dtype=np.uint32)
    sizes[-1] = n - FANOUT * (len(sizes) - 1)
    return sizes


def _subtree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The subtree over the nodes of one chunk. Beyond the first chunk a group is sure to have more
    nodes than one subtree holds; a group within one subtree ends as soon as one node remains."""
    grp, chunk = key
    rows = rows.sort_values("i", kind="stable")
    digests = sha256.from_bytes(b"".join(rows["digest"]))
    levels, states = [], []
    while len(levels) < LEVELS and (chunk > 0 or digests.shape[1] > 1):
        levels.append(sha256.to_bytes(digests))
        digests, kept = parents_of(digests)
        states.append(b"".join(sha256.to_bytes(s) for s in kept))
    return pd.DataFrame({"grp": [grp], "chunk": [chunk], "digest": [sha256.to_bytes(digests)],
                         "levels": [levels], "states": [states]})


def subtrees(nodes: DataFrame) -> list[DataFrame]:
    """Stored subtrees over ``nodes`` (grp, i from 0 without gaps, digest), the lowest first.

    Each further table has the roots of the one before as its nodes; the last has one row per group.
    """
    tables = []
    while True:
        chunked = nodes.withColumn("chunk", F.floor(F.col("i") / F.lit(FANOUT ** LEVELS)).cast("long"))
        tables.append(stored(chunked.groupBy("grp", "chunk").applyInPandas(_subtree, _SUBTREE)))
        if not tables[-1].agg(F.max("chunk")).first()[0]:
            return tables
        nodes = tables[-1].select("grp", F.col("chunk").alias("i"), "digest")


def _opened(levels: list[bytes], states: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the digests (8, n) of the children and the states (8 slots, 8, m) their parents keep."""
    return [(sha256.from_bytes(nodes), sha256.from_bytes(kept).reshape(sha256.WORDS, FANOUT, -1).transpose(1, 0, 2))
            for nodes, kept in zip(levels, states)]


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per bottom node of a subtree its steps up to the subtree's root, then those above the root."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            opened = _opened(row.levels, row.states)
            n = opened[0][0].shape[1] if opened else 1
            befores, lefts, rights = ([[] for _ in range(n)] for _ in range(3))
            for height, (nodes, kept) in enumerate(opened):
                data = sha256.to_bytes(nodes)
                for i in range(n):
                    at = i // FANOUT ** height
                    run, slot = at // FANOUT * FANOUT, at % FANOUT
                    befores[i].append(sha256.to_bytes(kept[slot][:, run // FANOUT:run // FANOUT + 1]))
                    lefts[i].append(data[32 * run:32 * at])
                    rights[i].append(data[32 * (at + 1):32 * (run + FANOUT)])
            yield pd.DataFrame({
                "grp": row.grp, "chunk": [row.chunk * FANOUT ** LEVELS + i for i in range(n)],
                "subroot": row.subroot, "root": row.root, "befores": [b + list(row.befores) for b in befores],
                "lefts": [b + list(row.lefts) for b in lefts], "rights": [b + list(row.rights) for b in rights]})


def _descended(tables: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the nodes at the bottom of ``tables`` from those of their uppermost subtrees.

    ``paths``: grp, chunk, subroot, root and the steps above the subtree's root.
    """
    for table in reversed(tables):
        paths = stored(table.drop("digest").join(paths, ["grp", "chunk"]).mapInPandas(
            _steps, f"grp string, chunk long, subroot binary, root binary, {_STEPS}"))
    return paths


def resumed(digests: np.ndarray, at: np.ndarray, nodes: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Digests (8, k) of the parents if the children at ``at`` had ``digests`` (8, k): the state kept before
    the child's slot goes on with the new digest and the right siblings."""
    run, slot = at // FANOUT, at % FANOUT
    sizes, blocks = _run_sizes(nodes.shape[1])[run], sha256.hex_blocks(nodes)
    state = sha256.fed(kept[slot, :, run].T, sha256.hex_blocks(digests))
    for step in range(1, FANOUT):
        more = np.flatnonzero(slot + step < sizes)
        if len(more):
            state[:, more] = sha256.fed(state[:, more], blocks[:, at[more] + step])
    return sha256.ended(state, sizes)


def _resumed_above(digests: np.ndarray, before: bytes, left: bytes, right: bytes) -> np.ndarray:
    """As ``resumed`` where all digests take the place of one and the same child."""
    state = sha256.fed(sha256.from_bytes(before), sha256.hex_blocks(digests))
    siblings = sha256.hex_blocks(sha256.from_bytes(right))
    for step in range(siblings.shape[1]):
        state = sha256.fed(state, siblings[:, step:step + 1])
    return sha256.ended(state, np.array([(len(left) + len(right)) // 32 + 1], dtype=np.uint32))


def _folds(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    """Fold every leaf of a subtree, with its replacement if it has one, up to the root."""
    rows = rows.sort_values("i", kind="stable").reset_index(drop=True)
    tree = trees.iloc[0]
    opened = _opened(tree["levels"], tree["states"])
    n = len(rows)
    folded = sha256.from_bytes(b"".join(leaf if new is None else new for leaf, new in zip(rows["digest"], rows["replaced"])))
    at = np.arange(n)
    for nodes, kept in opened:
        folded = resumed(folded, at, nodes, kept)
        at = at // FANOUT
    for before, left, right in zip(tree["befores"], tree["lefts"], tree["rights"]):
        folded = _resumed_above(folded, before, left, right)

    # Siblings as hex text from a node up to the root, the parts above shared by all nodes below.
    above = ["".join(left.hex() + right.hex() for left, right in zip(tree["lefts"], tree["rights"]))]
    for nodes, _ in reversed(opened):
        text = sha256.to_bytes(nodes).hex()
        above = [text[64 * (i - i % FANOUT):64 * i] + text[64 * (i + 1):64 * (i - i % FANOUT + FANOUT)] + above[i // FANOUT]
                 for i in range(nodes.shape[1])]
    out, root = rows.drop(columns=["digest", "replaced", "grp", "chunk", "i"]), tree["root"]
    back = sha256.to_bytes(folded)
    out["leaf"] = [d.hex() for d in rows["digest"]]
    out["subroot"], out["root"] = tree["subroot"].hex(), root.hex()
    out["proof_sha256"] = [hashlib.sha256(p.encode()).hexdigest() for p in above]
    out["folded_root"] = [back[32 * i:32 * i + 32].hex() for i in range(n)]
    out["verified"] = [back[32 * i:32 * i + 32] == root for i in range(n)]
    return out


def manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored subtrees over ``leaves`` and the path of every subtree to the dataset's root.

    ``leaves``: ``grp`` (string, groups ordered bytewise), ``i`` (a leaf's place in its group, from 0
    without gaps) and ``digest`` (32 bytes). Each group is a tree of its own; the roots of the groups, in
    their order, are the leaves of one more tree. Rows of the first table: ``grp``, ``chunk``, the subtree's
    root ``digest`` and per level the nodes' digests (``levels``) and the states their parents keep
    (``states``). Rows of the second: ``grp``, ``chunk``, ``subroot``, ``root`` and per step to the root the
    state before the own slot and the siblings left and right of it. Both are empty without leaves.
    """
    groups = subtrees(leaves)
    subroots = groups[-1].select("grp", F.col("digest").alias("subroot"), F.lit("").alias("all"), F.lit(1).cast("long").alias("one"))
    ranked = stored(prefix_sums(subroots, "all", ["grp"], "one", "i"))
    roots = subtrees(ranked.select(F.col("all").alias("grp"), "i", F.col("subroot").alias("digest")))
    none = F.array().cast("array<binary>")
    top = roots[-1].select("grp", "chunk", F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"),
                           none.alias("befores"), none.alias("lefts"), none.alias("rights"))
    of_groups = (_descended(roots, top).drop("grp", "subroot").withColumnRenamed("chunk", "i")
                 .join(ranked.select("grp", "i", "subroot"), "i")
                 .select("grp", F.lit(0).cast("long").alias("chunk"), "subroot", "root", "befores", "lefts", "rights"))
    return groups[0], _descended(groups[1:], of_groups)


def fold(leaves: DataFrame, trees: DataFrame, paths: DataFrame) -> DataFrame:
    """Per leaf the root that follows when it alone takes its ``replaced`` digest (its own if that is null).

    Adds hex strings ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (over all siblings on the way up, from
    the lowest level, left to right) and ``folded_root``, and ``verified``, whether that equals the root.
    Other columns of ``leaves`` stay but for grp, i and the binary digests.
    """
    others = [f"`{c}` {t}" for c, t in leaves.dtypes if c not in ("grp", "i", "digest", "replaced")]
    schema = ", ".join([*others, "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"])
    chunked = leaves.withColumn("chunk", F.floor(F.col("i") / F.lit(FANOUT ** LEVELS)).cast("long"))
    whole = trees.drop("digest").join(paths, ["grp", "chunk"])
    return chunked.groupBy("grp", "chunk").cogroup(whole.groupBy("grp", "chunk")).applyInPandas(_folds, schema)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Every row of documents as a leaf: doc_id, ``grp`` from lang, ``i``, ``digest`` and ``replaced``.

    Leaves of a lang ascend by doc_id, null ids first; rows with the same id follow by digest, and equal
    rows may swap. A null lang is a group of its own before all others. Where 3 divides the CRC-32 of the
    decimal doc_id (never for a null one), ``replaced`` is the digest with A-Z of the text lower-cased;
    a null text stays null. Columns beside the five of documents do not matter, whatever their names.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"),
                         leaf_digest(*fields, F.col("text")).alias("digest"),
                         F.when(tampered, leaf_digest(*fields, lowered(F.col("text")))).alias("replaced"),
                         F.lit(1).cast("long").alias("one"))
    return stored(prefix_sums(stored(leaves), "grp", ["doc_id", "digest"], "one", "i").drop("one"))


def audit(docs: DataFrame) -> DataFrame:
    """Manifest of documents and, per row, what its proof says about a copy with some texts lower-cased.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row; repeated
    rows are leaves each. An empty table has no rows.
    """
    leaves = document_leaves(docs)
    # Ids travel as text: a column of integers with a null would become one of floats in a task.
    folded = fold(leaves.withColumn("doc_id", F.col("doc_id").cast("string")), *manifest(leaves))
    return folded.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
