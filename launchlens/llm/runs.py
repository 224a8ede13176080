"""Periodic runs of words: suffix trees of a text and its reversal, Lyndon roots extended both ways."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from launchlens.llm import words as W

#: Words per shingle of the search for stretches that may hold a run.
SHINGLE = 4
#: Words of stretches that share one pair of trees; a longer stretch has a pair of its own.
TREE_WORDS = 1 << 14
#: Entries per block of the range-minimum table.
RMQ_BLOCK = 16


def suffix_tree(s: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ukkonen's tree of `s`, whose last symbol occurs nowhere else, as an Euler tour.

    Returns the string depth at each step of the tour, and for every suffix the step of its leaf and its
    rank among all suffixes (children are visited in the order of their symbols). Links, the
    active point and open leaf ends make the construction linear.
    """
    n = len(s)
    start, end, link = [0], [0], [0]
    edges: list[dict[int, int]] = [{}]
    node, edge, length = 0, 0, 0
    left = 0
    for i in range(n):
        c = s[i]
        left += 1
        waiting = 0
        while left:
            if not length:
                edge = i
            head = s[edge]
            child = edges[node].get(head)
            if child is None:
                edges[node][head] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                edges.append({})
                if waiting:
                    link[waiting] = node
                waiting = 0
            else:
                span = min(end[child], i + 1) - start[child]
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if s[start[child] + length] == c:
                    length += 1
                    if waiting:
                        link[waiting] = node
                    break
                middle = len(start)
                start.append(start[child])
                end.append(start[child] + length)
                link.append(0)
                edges.append({s[start[child] + length]: child, c: middle + 1})
                edges[node][head] = middle
                start.append(i)
                end.append(n)
                link.append(0)
                edges.append({})
                start[child] += length
                if waiting:
                    link[waiting] = middle
                waiting = middle
            left -= 1
            if not node and length:
                length -= 1
                edge = i - left + 1
            elif node:
                node = link[node]
    tour: list[int] = []
    step, rank = np.zeros(n, np.int64), np.zeros(n, np.int64)
    seen = 0
    work = [(0, 0)]
    while work:
        v, depth = work.pop()
        tour.append(depth)
        if v < 0:
            continue
        below = edges[v]
        if below:
            for _, child in sorted(below.items(), reverse=True):
                # the parent stands in the tour again after each child
                work.append((-1, depth))
                work.append((child, depth + end[child] - start[child]))
        else:
            step[n - depth], rank[n - depth] = len(tour) - 1, seen
            seen += 1
    return np.array(tour, np.int64), step, rank


class CommonPrefix:
    """Length of the longest common prefix of any two suffixes: the depth of their lowest common ancestor.

    The ancestor is the minimum of the tour between two leaves: blocks have prefix and suffix
    minima and a sparse table over their minima, so a query is four lookups.
    """

    def __init__(self, tour: np.ndarray, step: np.ndarray) -> None:
        self.step = step
        n_blocks = -(-len(tour) // RMQ_BLOCK)
        padded = np.full(n_blocks * RMQ_BLOCK, np.iinfo(np.int64).max)
        padded[: len(tour)] = tour
        blocks = padded.reshape(n_blocks, RMQ_BLOCK)
        self.padded = padded
        self.to_end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.from_start = np.minimum.accumulate(blocks, axis=1).ravel()
        self.table = [blocks.min(axis=1)]
        while 2 << len(self.table) - 1 <= n_blocks:
            half, last = 1 << len(self.table) - 1, self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.step[i], self.step[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        first, last = a // RMQ_BLOCK, b // RMQ_BLOCK
        out = np.minimum(self.to_end[a], self.from_start[b])
        inner = last - first - 1
        for level in range(len(self.table)):
            at = np.flatnonzero((inner >> level) == 1)
            if len(at):
                t = self.table[level]
                out[at] = np.minimum(out[at], np.minimum(t[first[at] + 1], t[last[at] - (1 << level)]))
        near = np.flatnonzero(first == last)
        if len(near):
            low = self.padded[a[near]].copy()
            for k in range(1, RMQ_BLOCK):
                at = a[near] + k
                inside = at <= b[near]
                low[inside] = np.minimum(low[inside], self.padded[at[inside]])
            out[near] = low
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller value, or the length: where the longest Lyndon word from there ends."""
    out = [len(rank)] * len(rank)
    stack: list[int] = []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def maximal_runs(symbols: np.ndarray, least: int = 6, repeats: int = 4) -> np.ndarray:
    """(start, length, period) of all runs with length >= max(least, repeats * period), repeats >= 2, by start, then period.

    Every run has a Lyndon root that is the longest Lyndon word from its start, in the order of the
    symbols or in the reversed one, so two candidates a place suffice. Each is extended to the right by the
    common prefix of two suffixes and to the left by that of two suffixes of the reversal.
    Symbols below zero must each occur once; no run contains one.
    """
    n = len(symbols)
    if n < max(least, 2):
        return np.empty((0, 3), np.int64)
    end = int(symbols.min()) - 1 if symbols.min() < 0 else -1
    forward = suffix_tree([*symbols.tolist(), end])
    after = CommonPrefix(*forward[:2])
    before = CommonPrefix(*suffix_tree([*symbols[::-1].tolist(), end])[:2])
    rank = forward[2][:n]
    found = []
    for order in (rank, -rank):
        i = np.arange(n)
        j = np.array(next_smaller(order.tolist()))
        if order is not rank:
            # the end of the text is the greatest symbol here, so no word from i ends before it
            i, j = i[j < n], j[j < n]
        right = after(i, j)
        left = np.zeros(len(i), np.int64)
        back = np.flatnonzero(i > 0)
        left[back] = before(n - i[back], n - j[back])
        start, length, period = i - left, left + (j - i) + right, j - i
        long = length >= np.maximum(least, repeats * period)
        found.append(np.stack([start[long], length[long], period[long]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def stretches(symbols: np.ndarray, doc: np.ndarray, least: int = 6, repeats: int = 4) -> list[tuple[int, int]]:
    """Ranges of words outside of which no run lies, from one sort of the shingles of all texts.

    In a run of period q every shingle that starts up to q + SHINGLE words before its end occurs again q words
    later. So the starts of shingles that occur again in their text form a stretch of m >= length - q - SHINGLE + 1
    places, each at most q from its next occurrence, and q <= (m + SHINGLE - 1) / (repeats - 1); the run ends within
    q + SHINGLE words after the stretch. Nothing else is left out. Needs least > SHINGLE and repeats >= 3, for m > 0.
    """
    n = len(symbols) - SHINGLE + 1
    if n < 2:
        return []
    key = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(SHINGLE):
        key = W.mix(key * np.uint64(3) + symbols[k : k + n].astype(np.uint64))
    key[doc[:n] != doc[SHINGLE - 1 :]] = 0
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero((key[order[:-1]] == key[order[1:]]) & (key[order[:-1]] != 0))
    if not len(again):
        return []
    distance = np.zeros(n, np.int64)
    distance[order[again]] = order[again + 1] - order[again]
    # places whose next occurrence is near enough for the stretch that holds them; shorter stretches allow less, so look again
    bounds = np.searchsorted(doc, np.arange(doc[-1] + 2))
    good = distance > 0
    for _ in range(20):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
        lo, hi = edge[::2], edge[1::2]
        limit = (hi - lo + SHINGLE - 1) // (repeats - 1)
        allowed = np.repeat(limit, hi - lo)
        inside = np.flatnonzero(good)
        far = distance[inside] > allowed
        if not far.any():
            break
        good[inside[far]] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
    lo, hi = edge[::2], edge[1::2]
    limit = (hi - lo + SHINGLE - 1) // (repeats - 1)
    wide = np.minimum(hi + limit + SHINGLE + 1, bounds[doc[lo] + 1]) if len(lo) else hi
    out: list[tuple[int, int]] = []
    for a, b in zip(lo.tolist(), wide.tolist(), strict=True):
        if out and a <= out[-1][1] and doc[a] == doc[out[-1][0]]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if b - a >= least]


def block_runs(symbols: np.ndarray, doc: np.ndarray, least: int = 6, repeats: int = 4) -> np.ndarray:
    """(place of the first word, length, period) of the runs of every text of a block, by place, then period."""
    ranges = stretches(symbols, doc, least, repeats)
    found, group, size = [], [], 0

    def close() -> None:
        if not group:
            return
        parts, starts, places = [], [], []
        at = 0
        for k, (a, b) in enumerate(group):
            starts.append(at)
            places.append(a)
            parts += [symbols[a:b], np.array([0], symbols.dtype)]
            at += b - a + 1
        joined = np.concatenate(parts)
        _, joined = np.unique(joined, return_inverse=True)
        joined = joined.astype(np.int64)
        starts_at = np.array(starts)
        marks = np.append(starts_at[1:], at) - 1
        joined[marks] = -np.arange(1, len(marks) + 1)
        runs = maximal_runs(joined, least, repeats)
        if len(runs):
            which = np.searchsorted(starts_at, runs[:, 0], "right") - 1
            runs[:, 0] += np.array(places)[which] - starts_at[which]
            found.append(runs)

    for a, b in ranges:
        if group and size + b - a > TREE_WORDS:
            close()
            group, size = [], 0
        group.append((a, b))
        size += b - a
    close()
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Mask of the words of a text that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def repeat_tail(n: int, doc_id: int) -> tuple[int, int] | None:
    """(first word, period) of the tail that the registered query makes periodic in a text of n words, or None."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


RUNS = "_keys struct<>, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), least: int = 6, repeats: int = 4, make_tail: bool = False, digest: bool = False) -> DataFrame:
    """Runs of every whole text: a struct _keys of the columns `keys`, n_words, runs (by start, then period) and collapsed.

    A run is a stretch of consecutive words with smallest period q, of max(least, repeats * q) words at least,
    that no neighbouring word extends. `collapsed` is the text without the words that a run holds after its
    first q words, joined by one space; with `digest` the hex SHA-256 of it. `make_tail` changes words first as `repeat_tail` says
    (by doc_id, which must be a key; a null doc_id changes nothing).

    Words are compared by 64-bit hashes. Texts are read in blocks of about 1 MB, one longer text is a block of its own; memory
    is a few dozen times that. Null texts count as empty: no words, no runs, an empty collapsed text. Null
    ids and repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    if least <= SHINGLE or repeats < 3:
        raise ValueError(f"least must be over {SHINGLE} and repeats 3 or more")
    source = docs.select(F.struct(*keys).alias("_keys"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    types = RUNS.replace("struct<>", source.schema["_keys"].dataType.simpleString())
    id_at = keys.index("doc_id") if make_tail else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            ids = batch.column(0).field(id_at).to_pylist() if make_tail else [None] * batch.num_rows
            rows = ((i, t) for i, (t,) in zip(ids, W.arrow_rows([batch.select([1])], "_text"), strict=True))
            n_words, runs, collapsed = [], [], []
            for block in W.blocks(rows, 1):
                for n, r, text in _block(block, least, repeats):
                    n_words.append(n)
                    runs.append([{"start": a, "length": b, "period": c} for a, b, c in r.tolist()])
                    collapsed.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(runs, run_type), pa.array(collapsed, pa.string())], names=["_keys", "n_words", "runs", "collapsed"])

    return source.mapInArrow(run, types)


def _block(block: list[tuple], least: int, repeats: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(words, runs, collapsed text) of each (doc_id, text) of a block."""
    w = W.split([t for _, t in block])
    bounds = w.bounds()
    symbols = w.hash.copy()
    tails = {}
    for d, (i, _) in enumerate(block):
        n = int(bounds[d + 1] - bounds[d])
        tail = repeat_tail(n, i) if i is not None else None
        if tail:
            a, p = tail
            places = np.arange(n)
            places[a:] = a + np.arange(n - a) % p
            tails[d] = places
            symbols[bounds[d] : bounds[d + 1]] = w.hash[bounds[d] : bounds[d + 1]][places]
    with np.errstate(over="ignore"):
        found = block_runs(symbols, w.doc, least, repeats) if len(symbols) else np.empty((0, 3), np.int64)
    ends = np.searchsorted(found[:, 0], bounds)
    for d, (_, text) in enumerate(block):
        n = int(bounds[d + 1] - bounds[d])
        runs = found[ends[d] : ends[d + 1]] - [bounds[d], 0, 0]
        if d not in tails and not len(runs):
            # bytes are split at the same six characters
            yield n, runs, b" ".join(text.split())
            continue
        parts = text.split()
        places = tails.get(d, np.arange(n))[kept_words(n, runs)]
        yield n, runs, b" ".join([parts[k] for k in places.tolist()])


def run_digests(found: DataFrame) -> DataFrame:
    """The columns of the registered query from `find_runs(..., digest=True)`: counts, the greatest run and the digests."""
    greatest = F.array_sort(
        F.col("runs"),
        lambda a, b: F.when(a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1))
        .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        .otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)),
    )
    first = F.get(greatest, F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text: Column = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select("_keys.*", F.size("runs").cast("long").alias("n_runs"), first.alias("_r"), text.alias("_lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        F.col("_r.start").alias("start"),
        F.col("_r.length").alias("length"),
        F.col("_r.period").alias("period"),
        F.floor(F.lit(1000) * F.col("_r.length") / F.col("_r.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("_lines").cast("binary"), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )
