"""Vectors of word hashes inside tasks, for the operators on word sequences."""

from __future__ import annotations

from .common import keep_for_a_partition

#: Bytes of words whose hashes a worker keeps, at about 150 bytes of overhead each.
MEMO_BYTES = 24 << 20
_memo: dict[bytes, int] = {}
_size = [0]
_BASE = 0x9E3779B97F4A7C15
_table: dict = {}


def forget() -> None:
    """Empty the kept hashes and tables."""
    _memo.clear()
    _table.clear()
    _size[0] = 0


keep_for_a_partition(forget)


def word_hashes(words: list[bytes]):
    """A 64-bit hash of each word."""
    import numpy as np
    import xxhash

    got = list(map(_memo.get, words))
    if None in got:
        if _size[0] > MEMO_BYTES:
            forget()
        for i, x in enumerate(got):
            if x is None:
                w = words[i]
                got[i] = xxhash.xxh3_64_intdigest(w)
                if len(w) <= 64:
                    _memo[w] = got[i]
                    _size[0] += len(w) + 150
    return np.array(got, np.uint64)


def mix(x, seed: int = 0):
    """A bijective 64-bit finaliser of an array."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = x ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int):
    """Powers of the base and of its inverse (modulo 2 ** 64) up to n, kept and grown as needed."""
    import numpy as np

    if len(_table.get("up", ())) < n:
        size = max(n, 4096, 2 * len(_table.get("up", ())))
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            _table["up"], _table["down"] = np.cumprod(up), np.cumprod(down)
    return _table["up"][:n], _table["down"][:n]


def window_hashes(hashes, size: int):
    """A 64-bit hash of each window of ``size`` consecutive word hashes, from prefix sums; empty if there are fewer words."""
    import numpy as np

    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    up, down = _powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(hashes * down, out=sums[1:])
        return mix((sums[size:] - sums[:n]) * up[:n], size)


def sequence_digest(hashes, seed: int) -> int:
    """A 64-bit digest of a whole sequence of word hashes, as a signed integer; 0 for none."""
    import numpy as np

    with np.errstate(over="ignore"):
        places = np.arange(1, len(hashes) + 1, dtype=np.uint64) * np.uint64(_BASE)
        return int(mix(hashes + places, seed).sum(dtype=np.uint64).astype(np.int64))


def signed(x):
    """The same bits as signed integers, which Spark's long holds."""
    return x.view("int64")
