"""Hashes of words, shingles and byte strings over many texts at once, in numpy.

A word is a maximal run of ASCII letters and digits and of other code points that aren't
punctuation or spaces of the blocks named in `_blank`, after lower-casing. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)  # a random number for each byte value
BYTE2 = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
BASE, BASE2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i up to n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(18, (n + 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (both[0], both[1])
    return have


def chunks(texts: Iterable[str | None], most: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in runs of about `most` characters; null counts as empty."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if run and size + len(t) > most:
            yield first, run
            run, size, first = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def prefix_hash(data: np.ndarray, byte: np.ndarray = BYTE, base: int = BASE) -> np.ndarray:
    """P with P[j] - P[i] = sum of byte[data[x]] * base ** x over i <= x < j."""
    up, _ = powers(base, len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """The hash of data[start:end], the same wherever the string stands."""
    _, down = powers(base, len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def _blank(data: np.ndarray, word: np.ndarray) -> None:
    """Marks Latin-1 signs, general punctuation and CJK punctuation as no part of a word."""
    lead = np.flatnonzero(data[:-2] >= 0xC2) if len(data) > 2 else np.empty(0, dtype=np.int64)
    if not len(lead):
        return
    a, b = data[lead], data[lead + 1]
    two = lead[(a == 0xC2) & ~np.isin(b, (0xAA, 0xB5, 0xBA))]
    three = lead[((a == 0xE2) & (b <= 0x81)) | ((a == 0xE3) & (b == 0x80))]
    for at, n in ((two, 2), (three, 3)):
        for i in range(n):
            word[at + i] = False


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts in turn, and each text's first place among them (one more at the end)."""
    raw = [utf8(t.lower()) for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    word = _IS_WORD[data]
    _blank(data, word)
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    hashes = span_hash(prefix_hash(data), start, end)
    begin = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=begin[1:])
    return hashes, np.searchsorted(start, begin)


def shingles(texts: list[str], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of n words of each text in turn, and each text's first place (one more at the end).

    A text of fewer than n words has none.
    """
    hashes, first = words(texts)
    count = np.maximum(np.diff(first) - (n - 1), 0)
    at = np.zeros(len(first), dtype=np.int64)
    np.cumsum(count, out=at[1:])
    if not at[-1]:
        return np.empty(0, dtype=np.uint64), at
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    up, _ = powers(BASE2, n)
    for i in range(n):
        total += hashes[i : len(hashes) - n + 1 + i] * up[i + 1]
    keep = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], count)
    return mix(total[keep]), at


def links_of(linked: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, count: np.ndarray, same: bool) -> list[tuple[int, int, int]]:
    """(id, least id reached by links in here, rows linked directly) of each that has a link.

    linked: of places `left` (rows) to places `right` (columns) of ids, all or two disjoint blocks;
    count: the rows that each id stands for.
    """
    if same:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return []
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    while True:
        after = rank.copy()
        after[left] = np.minimum(after[left], np.where(linked, rank[right][None], len(ids)).min(axis=1))
        after[right] = np.minimum(after[right], np.where(linked, after[left][:, None], len(ids)).min(axis=0))
        if (after == rank).all():
            break
        rank = after
    total = np.zeros(len(ids), dtype=np.int64)
    total[left] += linked @ count[right]
    if not same:
        total[right] += linked.T @ count[left]
    by_rank = np.sort(ids)
    return [(int(ids[i]), int(by_rank[rank[i]]), int(total[i])) for i in np.flatnonzero(total)]
