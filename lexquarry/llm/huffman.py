"""Canonical length-limited Huffman codes over token ids, in numpy.

Lengths come from the package-merge rule.  Codes are packed most significant
bit first; the bit length of every block of BLOCK ids is kept, so that each
block can be decoded by itself.  The decoder reads LIMIT bits at the place of
every block at once and looks the symbol and its length up in one table.
"""

from __future__ import annotations

import numpy as np

#: Longest code in bits; 2 ** LIMIT must hold the symbols, and LIMIT + 7 must fit 32 bits.
LIMIT = 20
#: Ids between two bit-offset checkpoints.
BLOCK = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, 0 for a symbol that doesn't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    items, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        items = both[by]
        is_leaf.append(by < len(leaves))
    depth, take = np.zeros(len(leaves), np.uint8), 2 * len(leaves) - 2
    for level in reversed(is_leaf):
        n = int(level[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol: by length, then by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    step = np.int64(1) << (int(lengths.max(initial=0)) - lengths[order].astype(np.int64))
    at = np.cumsum(step) - step
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = at >> (int(lengths.max(initial=0)) - lengths[order].astype(np.int64))
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of some ids, and the bits of each block."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    wide = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    marks = ends[np.append(np.arange(BLOCK - 1, len(ids) - 1, BLOCK), len(ids) - 1)]
    return out.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], np.diff(marks, prepend=0)


def table_of(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbol * 256 + length for every run of as many bits as the longest code has."""
    most = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    entry = order.astype(np.int64) << 8 | lengths[order]
    table = np.zeros(1 << most, np.int64)
    filled = np.repeat(entry, 1 << (most - lengths[order].astype(np.int64)))
    table[: len(filled)] = filled
    return table, most


def unpack(payload: bytes, bits: np.ndarray, n: int, table: np.ndarray, most: int) -> np.ndarray:
    """The n ids of a payload; all blocks advance together, each from its own checkpoint."""
    if not n:
        return np.zeros(0, np.int64)
    data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    at = np.cumsum(bits) - bits
    out = np.zeros((len(bits), BLOCK), np.int64)
    full, rest = len(bits) - 1, n - BLOCK * (len(bits) - 1)
    for k in range(BLOCK):
        if k == rest and full < len(at):
            at = at[:full]
        if not len(at):
            break
        got = table[(window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - most)]
        out[: len(at), k] = got >> 8
        at = at + (got & 255)
    return out.reshape(-1)[:n]
