"""Word tables over batches of texts in numpy, and small helpers the Python-side operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text handled at once; numpy work arrays take a few dozen times this.
BLOCK_BYTES = 1 << 20


@dataclass
class Words:
    """Words of a block of texts, in order. `start` and `end` are byte offsets into `data`."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    n_docs: int

    def bounds(self) -> np.ndarray:
        """Offsets into the words: words of text d are bounds[d] : bounds[d + 1]."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _random64(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


def byte_classes(kind: str = "words") -> np.ndarray:
    """Class of every byte: 0 white space; words: 1 the rest; tokens: 1 letters and digits, 2 other marks."""
    table = np.ones(256, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    if kind == "tokens":
        for b in range(33, 127):
            if not chr(b).isalnum():
                table[b] = 2
    return table


def fold_case() -> np.ndarray:
    """Lower case for A-Z, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def split(texts: list[bytes], kind: str = "words", lower: bool = False) -> Words:
    """All runs of one byte class as words, each with a 64-bit hash of its bytes.

    The hash is a sum of random values of (byte, place in the word), so equal words have
    equal hashes in every process; places past 64 reuse mixed powers.
    """
    data = np.frombuffer(b"\n".join(texts), np.uint8) if texts else np.empty(0, np.uint8)
    if lower:
        data = fold_case()[data]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    none = np.empty(0, np.int64)
    if not len(data):
        return Words(data, none, none, none, np.empty(0, np.uint64), len(texts))
    cls = byte_classes(kind)[data]
    change = np.flatnonzero(np.diff(cls)) + 1
    edges = np.concatenate([[0], change, [len(data)]])
    keep = cls[edges[:-1]] > 0
    start, end = edges[:-1][keep], edges[1:][keep]
    if not len(start):
        return Words(data, none, none, none, np.empty(0, np.uint64), len(texts))
    place = np.arange(len(data)) - np.repeat(edges[:-1], np.diff(edges))
    values, powers = _random64(256, 17), _random64(64, 99) | np.uint64(1)
    with np.errstate(over="ignore"):
        terms = values[data] * powers[place & 63]
        far = place >= 64
        if far.any():
            terms[far] *= mix(place[far].astype(np.uint64) >> np.uint64(6)) | np.uint64(1)
        terms[cls == 0] = 0
        h = np.add.reduceat(terms, start)
        # a run's sum reaches to the next run's start; only white space, with value 0, lies between
        h = mix(h + (end - start).astype(np.uint64))
    return Words(data, start, end, np.searchsorted(first, start, "right") - 1, h, len(texts))


def shingles(w: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every window of k words inside one text; texts of 1 to k-1 words give one window of all."""
    n = len(w.hash)
    with np.errstate(over="ignore"):
        if n >= k:
            acc = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                acc = mix(acc * np.uint64(3) + w.hash[j : n - k + 1 + j])
            inside = w.doc[: n - k + 1] == w.doc[k - 1 :]
            doc, h = w.doc[: n - k + 1][inside], acc[inside]
        else:
            doc, h = np.empty(0, np.int64), np.empty(0, np.uint64)
        if short and n:
            b = w.bounds()
            few = np.flatnonzero((np.diff(b) > 0) & (np.diff(b) < k))
            if len(few):
                extra = np.zeros(len(few), np.uint64)
                for j in range(k - 1):
                    has = np.diff(b)[few] > j
                    extra[has] = mix(extra[has] * np.uint64(5) + w.hash[b[few[has]] + j])
                doc, h = np.concatenate([doc, few]), np.concatenate([h, extra])
    return doc, h


def blocks(rows: Iterable[tuple], text_at: int, size: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Rows in runs of about `size` bytes of text; one longer text is a run of its own."""
    run, total = [], 0
    for row in rows:
        n = len(row[text_at])
        if run and total + n > size:
            yield run
            run, total = [], 0
        run.append(row)
        total += n
    if run:
        yield run


def arrow_rows(batches: Iterable, *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples; a few MB of Python objects at a time."""
    for batch in batches:
        step = 1024
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)
