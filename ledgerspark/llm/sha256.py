"""SHA-256 over many messages at once, with its inner state in the open.

A library's hash object cannot leave the process that made it. Here a state is eight 32-bit words
per message, kept as columns of a numpy array, so it can be stored, copied and resumed anywhere.
Messages are fed in whole blocks of 64 bytes; one hex digest is just one block.
"""

from math import isqrt

import numpy as np

WORDS = 8


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(n: int) -> int:
    """The largest integer whose cube is at most ``n``."""
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid ** 3 <= n else (low, mid - 1)
    return low


# The standard's constants: 32 bits after the point of the square and cube roots of the first primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], dtype=np.uint32)
ROUNDS = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], dtype=np.uint32)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def fresh(n: int) -> np.ndarray:
    """The states (8, n) of ``n`` messages before their first block."""
    return np.repeat(START[:, None], n, axis=1)


def fed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8, n) after one more block (16, n), or (16, 1) for the same block to all."""
    words = list(block)
    for i in range(16, 64):
        x, y = words[i - 15], words[i - 2]
        words.append(words[i - 16] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3)))
                     + words[i - 7] + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for constant, word in zip(ROUNDS, words):
        first = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + ((e & f) ^ (~e & g)) + (word + constant)
        second = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def ended(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests (8, n) of messages of ``blocks`` (n or 1) whole blocks that end here."""
    last = np.zeros((16, len(blocks)), dtype=np.uint32)
    last[0] = 0x80000000
    last[15] = blocks * 512
    return fed(state, last)


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests (8, n) as the block (16, n) of their lowercase hex text."""
    shifts = np.arange(28, -1, -4, dtype=np.uint32)
    nibbles = (digests[:, None, :] >> shifts[None, :, None]) & np.uint32(15)
    chars = (nibbles + np.uint32(48) + np.uint32(39) * (nibbles > 9)).reshape(16, 4, -1)
    return (chars[:, 0] << np.uint32(24)) | (chars[:, 1] << np.uint32(16)) | (chars[:, 2] << np.uint32(8)) | chars[:, 3]


def to_bytes(words: np.ndarray) -> bytes:
    """Columns (8, n) one after the other, 32 bytes each."""
    return words.T.astype(">u4").tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, ">u4").astype(np.uint32).reshape(-1, WORDS).T)
