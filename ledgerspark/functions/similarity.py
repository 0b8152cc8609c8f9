"""Similarity of one query with many texts at once, in numpy.

All scores are 100 x 2 x LCS / (length + length), LCS being the longest common
subsequence. It is found with the bit-parallel method (Hyyro 2004): the query is a row of
bits and one text character costs an addition and three logical operations, here for a
whole batch of texts together. Queries longer than 64 characters use several words.
"""

import numpy as np


def codes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Texts as a zero-padded matrix of code points, and their lengths."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    width = max(1, int(lengths.max(initial=0)))
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width), lengths


def letter_counts(texts, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text how many of its letters fall into each class (code point modulo ``classes``), and its length."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    counts = np.zeros((len(texts), classes), dtype=np.int32)
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % classes
    np.add.at(counts, (np.repeat(np.arange(len(texts)), lengths), letters), 1)
    return counts, lengths


def shared_letters(query: str, counts: np.ndarray) -> np.ndarray:
    """Most letters that the query can have in common with each counted text."""
    mine = letter_counts([query], counts.shape[1])[0]
    used = np.flatnonzero(mine[0])
    return np.minimum(counts[:, used], mine[:, used]).sum(axis=1)


def _bit_range(start: np.ndarray, end: np.ndarray, words: int) -> np.ndarray:
    """Masks with bits start..end-1 set, one more axis for the words."""
    base = np.arange(words) * 64
    lo = np.clip(start[..., None] - base, 0, 64)
    hi = np.clip(end[..., None] - base, 0, 64)

    def below(n):
        return np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))
    return below(hi) & ~below(lo)


def _positions(query: str, letters: np.ndarray, words: int) -> np.ndarray:
    """For every text character, the bits of the query positions that hold it."""
    code = np.array([ord(c) for c in query], dtype=np.uint32)
    alphabet = np.unique(code)
    table = np.zeros((len(alphabet) + 1, words), dtype=np.uint64)
    for i, c in enumerate(code):
        table[np.searchsorted(alphabet, c), i // 64] |= np.uint64(1) << np.uint64(i % 64)
    at = np.minimum(np.searchsorted(alphabet, letters), len(alphabet) - 1)
    return table[np.where(alphabet[at] == letters, at, len(alphabet))]


def _advance(row: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """One text character: row' = (row + (row & hits)) | (row - (row & hits))."""
    common = row & hits
    total = row + common
    if row.shape[-1] > 1:
        carry = np.zeros(row.shape[:-1], dtype=np.uint64)
        for w in range(row.shape[-1]):
            first = total[..., w]
            full = first + carry
            carry = ((first < row[..., w]) | (full < first)).astype(np.uint64)
            total[..., w] = full
    return total | (row - common)


def _common(row: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """LCS length: the query bits that were cleared."""
    return np.bitwise_count(~row & mask).sum(axis=-1, dtype=np.int64)


def _words(query: str) -> int:
    return (len(query) + 63) // 64


def full_ratio(query: str, texts) -> np.ndarray:
    """Score of the whole query against each whole text; 0 when one of them is empty."""
    if not query or not len(texts):
        return np.zeros(len(texts))
    letters, lengths = codes(texts)
    words = _words(query)
    hits = _positions(query, letters, words)
    row = np.full((len(texts), words), ~np.uint64(0))
    for j in range(letters.shape[1]):
        row = _advance(row, hits[:, j])
    mask = _bit_range(np.array(0), np.array(len(query)), words)
    return np.where(lengths > 0, 200.0 * _common(row, mask) / (len(query) + lengths), 0.0)


def _slide_query_over(query: str, letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best score of the query against every window of a text that is at least as long."""
    m, words = len(query), _words(query)
    count, width = letters.shape
    hits = np.zeros((count, width + m, words), dtype=np.uint64)
    hits[:, :width] = _positions(query, letters, words)
    mask = _bit_range(np.array(0), np.array(m), words)
    row = np.full((count, width, words), ~np.uint64(0))
    best, every = np.zeros(count), np.arange(count)
    for j in range(m):
        row = _advance(row, hits[:, j:j + width])
        # Windows cut off by the start or by the end of the text have j + 1 characters.
        cut = np.maximum(_common(row[:, 0], mask), _common(row[every, np.maximum(lengths - j - 1, 0)], mask))
        best = np.maximum(best, 200.0 * cut / (m + j + 1))
    return np.maximum(best, (200.0 * _common(row, mask) / (2 * m)).max(axis=1))


def _slide_over_query(query: str, letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best score of a text against every window of a query that is at least as long."""
    m, words = len(query), _words(query)
    ends = np.arange(1, m + letters.shape[1])
    start = np.maximum(ends[None, :] - lengths[:, None], 0)
    end = np.minimum(np.broadcast_to(ends, start.shape), m)
    end = np.maximum(end, start)
    window = _bit_range(start, end, words)
    hits = _positions(query, letters, words)
    row = np.full(window.shape, ~np.uint64(0))
    for j in range(letters.shape[1]):
        row = _advance(row, hits[:, j][:, None, :] & window)
    return (200.0 * _common(row, window) / np.maximum(end - start + lengths[:, None], 1)).max(axis=1)


def partial_ratio(query: str, texts) -> np.ndarray:
    """Best score of the shorter string against the windows of the longer one that are as
    long as it, or shorter where they are cut off by an end."""
    scores = np.zeros(len(texts))
    if not query or not len(texts):
        return scores
    letters, lengths = codes(texts)
    for rows, slide in ((lengths >= len(query), _slide_query_over),
                        ((lengths <= len(query)) & (lengths > 0), _slide_over_query)):
        if rows.any():
            kept = letters[rows][:, :int(lengths[rows].max())]
            scores[rows] = np.maximum(scores[rows], slide(query, kept, lengths[rows]))
    return scores


def token_set_ratio(query_words, text_words) -> np.ndarray:
    """Best of three scores between the shared words and the shared words followed by the
    rest of either side. Takes sorted word lists; 100 when one side holds the other."""
    asked = frozenset(query_words)
    scores = np.zeros(len(text_words))
    if not asked:
        return scores
    by_shared: dict[frozenset, list[int]] = {}
    for i, words in enumerate(text_words):
        if len(words):
            by_shared.setdefault(asked.intersection(words), []).append(i)
    for shared, members in by_shared.items():
        common = len(" ".join(shared))
        left = " ".join(sorted(asked - shared))
        right = [" ".join(sorted(set(text_words[i]) - shared)) for i in members]
        if shared and not left:
            scores[members] = 100.0
            continue
        gap = 1 if shared else 0
        a = common + gap + len(left)
        b = common + gap + np.array([len(r) for r in right])
        # A number of characters again, so that equal similarities are equal to the last bit.
        rest = np.rint(full_ratio(left, right) * (len(left) + b - common - gap) / 200.0)
        score = 200.0 * (common + gap + rest) / (a + b)
        if shared:
            score = np.maximum(score, np.maximum(200.0 * common / (common + a), 200.0 * common / (common + b)))
            score = np.where(b == common + gap, 100.0, score)
        scores[members] = score
    return scores
