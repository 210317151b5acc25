"""Canonical length-limited Huffman codes: package-merge lengths, block encoder, table-driven decoder."""

from __future__ import annotations

import numpy as np

LIMIT = 20
#: Ids between two bit-offset checkpoints of a block.
CHECKPOINT = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits; 0 for symbols that don't occur (package-merge)."""
    out = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    leaves = used[np.argsort(counts[used], kind="stable")]
    weight = counts[leaves].astype(np.float64)
    level, is_leaf = weight, [np.ones(len(leaves), dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < len(leaves))
    take, lens = 2 * len(leaves) - 2, np.zeros(len(leaves), dtype=np.uint8)
    for flags in reversed(is_leaf):
        k = int(flags[:take].sum())
        lens[:k] += 1
        take = 2 * (take - k)
    out[leaves] = lens
    return out


class Code:
    """The canonical code of given lengths: codes ascend by (length, symbol)."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        ln = self.lengths[order]
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.bits = int(ln[-1]) if len(ln) else 1
        first = np.cumsum(np.concatenate([[0], 1 << (self.bits - ln)]))  # of codes filled up to self.bits bits
        self.codes[order] = (first[:-1] >> (self.bits - ln)).astype(np.uint64)
        self.symbol = np.zeros(1 << self.bits, dtype=np.uint16)
        self.step = np.zeros(1 << self.bits, dtype=np.int64)
        self.symbol[: first[-1]] = np.repeat(order, 1 << (self.bits - ln)).astype(np.uint16)
        self.step[: first[-1]] = np.repeat(ln, 1 << (self.bits - ln))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of ids, high bit first, and the bit offsets of every CHECKPOINT-th id."""
        if not len(ids):
            return b"", np.zeros(0, dtype=np.uint32)
        ln = self.lengths[ids]
        ends = np.cumsum(ln)
        at = ends - ln
        size = int(ends[-1] + 7) // 8
        value = self.codes[ids] << (np.uint64(32) - (at & 7).astype(np.uint64) - ln.astype(np.uint64))
        byte, out = at >> 3, np.zeros(size + 4)
        for k in range(4):
            part = ((value >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64)
            out += np.bincount(byte + k, weights=part, minlength=size + 4)
        return out[:size].astype(np.uint8).tobytes(), at[::CHECKPOINT].astype(np.uint32)

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """n ids, all stretches between checkpoints at once: one table look-up a step."""
        b = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
        word = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        lanes = len(checkpoints)
        out = np.zeros((CHECKPOINT, lanes), dtype=np.uint16)
        pos, down = checkpoints.astype(np.int64), np.uint32(32 - self.bits)
        for k in range(CHECKPOINT if n >= CHECKPOINT else n):
            if lanes and (lanes - 1) * CHECKPOINT + k >= n:  # the last stretch has ended
                lanes -= 1
                pos = pos[:lanes]
            window = (word[pos >> 3] << (pos & 7).astype(np.uint32)) >> down
            out[k, :lanes] = self.symbol[window]
            pos = pos + self.step[window]
        return out.T.reshape(-1)[:n]
