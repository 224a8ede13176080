"""N-gram Jaccard join of whole texts: a size-aware heavy-light join, exact, with groups instead of all pairs.

Equal shingle sets are one set. A set is light up to a size that costs decide, else heavy.

* Light sets list all subsets of the sizes that an overlap with a light partner may need. Sets that share a
  subset of the size their two sizes need are linked, without another look.
* Heavy sets, and light ones large enough to link with a heavy one, scan inverted lists of their
  first shingles: in one order for all sets, frequent shingles last, the rest by
  hash, two sets that link share m shingles among the first size // 4 + m of each, with m = 1 + size // 32 of
  the smaller. Pairs that can reach their m are verified on the whole sets.

Which shingles count as frequent comes from a bitmap of fixed size; it decides what work is done and never
the result.

Groups, not pairs, are the result, so a pair is only verified while its two sets are not yet
in one group: first every set with its best two partners, then all listed pairs that still
stand in different groups. Pairs of long lists are looked at where blocks of a list meet, by sketches that bound
what two sets can share; only pairs that the bound allows become rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, functions as F

from launchlens.llm import words as W
from launchlens.llm.graph import PARTS_A_FILE, components
from launchlens.session import cut_lineage

#: Bits of the bitmaps over the leading bits of a shingle's hash.
MAP_BITS = 23
#: Shingles in more sets than these come later in the order, one class after the other; the last class is spread by Spark's own joins.
BOUNDS = (16, 64, 256, 1000)
#: Members of a long list's main group that each set outside of it is tried with before all of them.
LEADERS = 8
#: Sets above this size are always heavy.
LIGHT_MOST = 16
#: Lists up to this length give all their pairs, longer ones pairs with their best member first.
SHORT_LIST = 32
#: Shingles that one task of the inverted lists takes, about.
RANGE_SHINGLES = 2 << 20
#: Bits of a sketch's planes; a list above BLOCK_LIST members is cut into BLOCKS blocks, and lists below share cells of about CELL_ROWS members.
SKETCH_BITS, BLOCK_LIST, BLOCKS, CELL_ROWS = 2048, 1000, 8, 20_000


def _kept(df: DataFrame) -> DataFrame:
    """Checkpoint of rows that are small beside the texts, in files of several partitions."""
    return cut_lineage(df, PARTS_A_FILE)


def need(a: int, b: int, percent: int = 75) -> int:
    """Least overlap of linked sets of sizes a and b: 100 * overlap >= percent * (a + b - overlap)."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(n: int, percent: int = 75) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, light: int, percent: int = 75) -> list[int]:
    """Sizes of subsets that a set of n <= light lists."""
    return sorted({c for m in partner_sizes(n, percent) if 1 <= m <= light and (c := need(n, m, percent)) <= min(n, m)})


def first_count(n: np.ndarray, percent: int = 75) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def shared_count(n):  # noqa: ANN001, ANN201
    """Shingles that linked sets share at least among the first ones of a set of size n."""
    return 1 + n // 32


def light_bound(sizes: dict[int, int], percent: int = 75) -> int:
    """The size up to which sets are light: the least total of subsets listed, and of list rows and set elements moved for the rest."""
    heavy = lambda n: int(first_count(np.int64(n), percent)) + n
    best, bound = None, 0
    for x in range(LIGHT_MOST + 1):
        listed = sum(k * sum(comb(n, c) for c in subset_sizes(n, x, percent)) for n, k in sizes.items() if n <= x)
        scanned = sum(k * heavy(n) for n, k in sizes.items() if 100 * n >= percent * (x + 1))
        if best is None or listed + scanned < best:
            best, bound = listed + scanned, x
    return bound


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, by text and hash, and the key of every text's set (0 for none)."""
    w = W.split(texts, lower=True)
    doc, h = W.shingles(w, k)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        doc, h = doc[new], h[new]
    key = np.zeros(len(texts), np.uint64)
    if len(h):
        edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        with np.errstate(over="ignore"):
            key[doc[edge]] = W.mix(np.add.reduceat(W.mix(h), edge) + np.uint64(1)) | np.uint64(1)
    return doc, h, key


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, compressed: made for sorted differences and small numbers."""
    return zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), 1)


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))


def set_keys(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles and the key of the set, for every row."""
    source = _texts(docs)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sizes, keys = [], []
            for rows in W.blocks(W.arrow_rows([b.select([1])], "_text"), 0):
                doc, _, key = shingle_sets([r[0] for r in rows], k)
                sizes.append(np.bincount(doc, minlength=len(rows)))
                keys.append(key.view(np.int64))
            join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), join(sizes), join(keys)], names=["doc_id", "n_shingles", "key"])

    return source.mapInArrow(run, f"doc_id {kind}, n_shingles long, key long")


def _with_keys(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, _row and the key of the set of _text (0 for none), for every row."""
    rows = rows.select("doc_id", "_row", "_text")
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "_row"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            keys = [shingle_sets([r[0] for r in part], k)[2].view(np.int64) for part in W.blocks(W.arrow_rows([b.select([2])], "_text"), 0)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))], names=["doc_id", "_row", "key"])

    return rows.mapInArrow(run, f"{types}, key long")


def _new_sets(batches: Iterator, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sets of a task's texts, each key once."""
    seen: set[int] = set()
    for rows in W.blocks(W.arrow_rows(batches, "_text"), 0):
        doc, h, key = shingle_sets([r[0] for r in rows], k)
        fresh = np.zeros(len(key), bool)
        for d, x in enumerate(key.tolist()):
            if x and x not in seen:
                seen.add(x)
                fresh[d] = True
        keep = fresh[doc]
        yield doc[keep], h[keep], key


def frequent_maps(docs: DataFrame, k: int, range_bits: int) -> np.ndarray:
    """A bitmap for each of BOUNDS: shingles in more distinct sets than that, counted over all texts.

    Tasks send sorted hashes by range; a range counts its own and returns its stretch of all maps. Where more
    than an eighth of a stretch would be set, the bound doubles.
    """
    shift = np.uint64(64 - range_bits) if range_bits else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def send() -> Iterator:
            h = np.sort(np.concatenate(held))
            at = np.searchsorted(h >> shift if range_bits else h * np.uint64(0), np.arange((1 << range_bits) + 1, dtype=np.uint64))
            parts = []
            for r in range(1 << range_bits):
                x = h[at[r] : at[r + 1]]
                if len(x):
                    short = (x >> np.uint64(24)).astype(np.uint64)  # 40 bits are enough to tell shingles apart here
                    parts.append((r, _planes(np.diff(short, prepend=np.uint64(0)))))
            if parts:
                r, raw = zip(*parts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(raw, pa.binary())], names=["r", "h"])

        for _, h, _ in _new_sets(batches, k):
            held.append(h)
            size += len(h)
            if size > 4 << 20:
                yield from send()
                held, size = [], 0
        if held:
            yield from send()

    per = 1 << (MAP_BITS - range_bits)

    def count(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        h = np.sort(np.concatenate([np.cumsum(_numbers(x, "<u8"), dtype=np.uint64) for x in table.column("h").to_pylist()]))
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        n, h = np.diff(edge), h[edge[:-1]]
        at = (h >> np.uint64(40 - MAP_BITS)).astype(np.int64) & (per - 1)
        out = []
        for bound in BOUNDS:
            while (n > bound).sum() > per // 8:
                bound *= 2
            bits = np.zeros(per, bool)
            bits[at[n > bound]] = True
            out.append(zlib.compress(np.packbits(bits).tobytes()))
        return pa.table({"r": table.column("r")[:1], "maps": pa.array([out], pa.list_(pa.binary()))})

    maps = np.zeros((len(BOUNDS), 1 << range_bits, per // 8), np.uint8)
    # one row for each range: every map is 2 ** MAP_BITS bits, whatever the input; all in one job, not one for each partition
    for row in _texts(docs).select("_text").mapInArrow(run, "r int, h binary").groupBy("r").applyInArrow(count, "r int, maps array<binary>").collect():
        for m, raw in enumerate(row["maps"]):
            maps[m, row["r"]] = np.frombuffer(zlib.decompress(raw), np.uint8)
    return maps.reshape(len(BOUNDS), -1)


def _frequency(maps: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Class of every shingle: how many of BOUNDS it exceeds by the maps."""
    at = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    shift = (7 - (at & 7)).astype(np.uint8)
    out = np.zeros(len(h), np.int64)
    for bits in maps:
        out += (bits[at >> 3] >> shift) & 1
    return out


def list_rows(docs: DataFrame, k: int, percent: int, light: int, range_bits: int, maps: np.ndarray) -> DataFrame:
    """Rows of the inverted lists and of the light sets' subsets, each set once a task.

    kind 0: a range of shingle hashes r, packed: shingle, place of its set in the row's own list of sets, and for those
    key, size and rank (frequent share of the set, the higher the smaller). kind 1: the same for shingles in very many sets, kind 2:
    subsets, where `rank` is the subset's size; both with an r of their own, as they only pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    least = -(-percent * (light + 1) // 100)
    shift = np.uint64(64 - range_bits) if range_bits else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        maps = shared.value
        held: list[tuple] = []
        size = 0

        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0

        def pack(kind: int, r: int, h: np.ndarray, key: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple:
            _, one, place = np.unique(np.stack([key, rank.astype(np.uint64)], 1), axis=0, return_index=True, return_inverse=True) if kind == 2 else (None, *np.unique(key, return_index=True, return_inverse=True)[1:])
            return kind, r, _planes(np.diff(h, prepend=np.uint64(0))), _planes(np.asarray(place).ravel().astype("<u4")), key[one].tobytes(), _planes(n[one].astype("<u4")), _planes(rank[one].astype("<u4"))

        def send() -> Iterator:
            nonlocal number
            h, key, n, rank, kind = (np.concatenate([x[c] for x in held]) for c in range(5))
            parts = []
            for special in (1, 2):
                at = np.flatnonzero(kind == special)
                at = at[np.argsort(h[at], kind="stable")]
                for lo in range(0, len(at), 1 << 18):
                    s = at[lo : lo + (1 << 18)]
                    parts.append(pack(special, (1 << 30) + task * 1009 + number, h[s], key[s], n[s], rank[s]))
                    number += 1
            at = np.flatnonzero(kind == 0)
            at = at[np.argsort(h[at], kind="stable")]
            h, key, n, rank = h[at], key[at], n[at], rank[at]
            cut = np.searchsorted(h >> shift if range_bits else h * np.uint64(0), np.arange((1 << range_bits) + 1, dtype=np.uint64))
            parts += [pack(0, r, *(x[cut[r] : cut[r + 1]] for x in (h, key, n, rank))) for r in range(1 << range_bits) if cut[r] < cut[r + 1]]
            cols = list(zip(*parts, strict=True))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["kind", "r", "h", "place", "key", "n", "rank"])

        for doc, h, key in _new_sets(batches, k):
            if not len(h):
                continue
            often = _frequency(maps, h)
            size_of = np.bincount(doc, minlength=len(key))
            share = np.bincount(doc, often > 0, minlength=len(key)) / np.maximum(size_of, 1)
            rank_of = (1000 - np.floor(share * 1000)).astype(np.int64)
            order = np.lexsort((h, often, doc))
            d, x, level = doc[order], h[order], often[order]
            first = np.searchsorted(d, np.arange(len(key)))
            place = np.arange(len(d)) - first[d]
            keep = (place < (first_count(size_of, percent) + shared_count(size_of) - 1)[d]) & (size_of[d] >= least)
            d, x, level = d[keep], x[keep], level[keep]
            held.append((x, key[d], size_of[d], rank_of[d], np.where(level == len(maps), 1, 0)))
            for t in np.flatnonzero((size_of > 0) & (size_of <= light)):
                lo, hi = np.searchsorted(doc, t), np.searchsorted(doc, t, "right")
                mine = h[lo:hi]
                for c in subset_sizes(len(mine), light, percent):
                    pick = np.array(list(combinations(range(len(mine)), c)), np.int64)
                    with np.errstate(over="ignore"):
                        sub = np.full(len(pick), c + 1, np.uint64)
                        for j in range(c):
                            sub = W.mix(sub * np.uint64(7) + mine[pick[:, j]])
                    m = len(sub)
                    held.append((sub, np.full(m, key[t]), np.full(m, len(mine)), np.full(m, c), np.full(m, 2)))
            size += sum(len(v[0]) for v in held[-1:])
            if size > 2 << 20:
                yield from send()
                held, size = [], 0
        if held:
            yield from send()

    return _texts(docs).select("_text").mapInArrow(run, "kind int, r int, h binary, place binary, key binary, n binary, rank binary")


def scan_lists(rows: DataFrame, percent: int, light: int) -> DataFrame:
    """Pairs and long lists of every range: kind 0: (a, b, shared, rank of a, least shared); kind 1: (h, key, n, rank) of long lists, kind 2: of subsets.

    In a pair, a is the better ranked set: more of its shingles are frequent, or else its key is smaller.
    Pairs whose sizes cannot link, or that are both light, are left out.
    """

    def scan(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        cols = {c: table.column(c).to_pylist() for c in ("h", "place", "key", "n", "rank")}
        place = [_numbers(x, "<u4") for x in cols["place"]]
        h = np.concatenate([np.cumsum(_numbers(x, "<u8"), dtype=np.uint64) for x in cols["h"]])
        key = np.concatenate([np.frombuffer(x, np.int64)[p] for x, p in zip(cols["key"], place, strict=True)])
        n, rank = (np.concatenate([_numbers(x, "<u4")[p] for x, p in zip(cols[c], place, strict=True)]).astype(np.int64) for c in ("n", "rank"))
        kind = table.column("kind")[0].as_py()
        if kind:
            return pa.table({"kind": pa.array(np.full(len(h), kind, np.int32)), "x": pa.array(h.view(np.int64)), "y": pa.array(key), "n": pa.array(n), "rank": pa.array(rank), "least": pa.array(np.zeros(len(h), np.int64))})
        order = np.lexsort((key, rank, h))
        h, key, n, rank = h[order], key[order], n[order], rank[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
        h, key, n, rank = h[new], key[new], n[new], rank[new]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.concatenate([start, [len(h)]]))
        a, b = [], []
        for m in np.unique(size[(size > 1) & (size <= SHORT_LIST)]):
            lists = start[size == m]
            i, j = np.triu_indices(m, 1)
            a.append((lists[:, None] + i[None, :]).ravel())
            b.append((lists[:, None] + j[None, :]).ravel())
        long_lists = np.flatnonzero(size > SHORT_LIST)
        for s in long_lists:
            a.append(np.full(size[s] - 1, start[s]))
            b.append(np.arange(start[s] + 1, start[s] + size[s]))
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        ok = (100 * low >= percent * high) & (high > light)
        a, b = a[ok], b[ok]
        _, pair, inverse = np.unique(np.stack([key[a], key[b]], 1), axis=0, return_index=True, return_inverse=True) if len(a) else (None, np.empty(0, np.int64), np.empty(0, np.int64))
        count = np.bincount(np.asarray(inverse).ravel(), minlength=len(pair))
        pa_, pb_ = a[pair], b[pair]
        member = np.concatenate([np.arange(start[s], start[s] + size[s]) for s in long_lists]) if len(long_lists) else np.empty(0, np.int64)
        return pa.table(
            {
                "kind": pa.array(np.concatenate([np.zeros(len(pair)), np.ones(len(member))]).astype(np.int32)),
                "x": pa.array(np.concatenate([key[pa_], h[member].view(np.int64)])),
                "y": pa.array(np.concatenate([key[pb_], key[member]])),
                "n": pa.array(np.concatenate([count, n[member]]).astype(np.int64)),
                "rank": pa.array(np.concatenate([rank[pa_], rank[member]])),
                "least": pa.array(np.concatenate([shared_count(np.minimum(n[pa_], n[pb_])), np.zeros(len(member), np.int64)]).astype(np.int64)),
            }
        )

    return rows.groupBy("kind", "r").applyInArrow(scan, "kind int, x long, y long, n long, rank long, least long")


def whole_sets(docs: DataFrame, keys: DataFrame, named: DataFrame, k: int, pack: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(key, elements): `pack` of the sorted shingles of every set in `named` (key), once each.

    Texts are read again, and of the documents in a bitmap of fixed size the sets are sent; the join
    with the first document of every named set is exact. Sets that only rows without doc_id have are sent by key.
    """
    bits = 23
    rep = _kept(keys.where("n_shingles > 0").join(named, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id")))
    # sets that only rows without doc_id have go by their key
    nameless = rep.where("doc_id is null").select("key")
    rep = rep.where("doc_id is not null")
    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    words = (
        rep.select(F.shiftright(slot, 5).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(doc_id), {64 - bits}) & 31 as int))").alias("m"))
        .groupBy("w")
        .agg(F.bit_or("m").alias("m"))
        .collect()
    )
    table = np.zeros(1 << (bits - 5), np.uint32)
    for r in words:
        table[r["w"]] = r["m"]
    shared = docs.sparkSession.sparkContext.broadcast(table)
    source = _texts(docs).select("_text", F.when(F.col("doc_id").isNotNull(), slot).otherwise(-1).cast("int").alias("slot"), "doc_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = shared.value

        for b in batches:
            at = b.column(1).to_numpy()
            keep = (at < 0) | ((table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)
            if not keep.any():
                continue
            b = b.filter(pa.array(keep))
            ids, raw, keys_ = [], [], []
            for rows in W.blocks(W.arrow_rows([b], "_text", "doc_id"), 0):
                doc, h, key = shingle_sets([r[0] for r in rows], k)
                cut = np.searchsorted(doc, np.arange(len(rows) + 1))
                ids += [r[1] for r in rows]
                keys_.append(key.view(np.int64))
                raw += [pack(h[s:e]) if e > s else b"" for s, e in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(2).type), pa.array(np.concatenate(keys_)), pa.array(raw, pa.binary())], names=["doc_id", "key", "elements"])

    kind = source.schema["doc_id"].dataType.simpleString()
    sets = lambda rows: source.where(rows).mapInArrow(run, f"doc_id {kind}, key long, elements binary")
    out = sets("doc_id is not null").join(rep, ["key", "doc_id"], "left_semi").select("key", "elements")
    if not nameless.isEmpty():
        out = out.union(sets("doc_id is null").select("key", "elements").join(nameless, "key", "left_semi"))
    # repeated rows of a first document give its set again
    return out.groupBy("key").agg(F.min("elements").alias("elements"))


def verify(docs: DataFrame, keys: DataFrame, pairs: DataFrame, k: int, percent: int, chunk: int = 256) -> DataFrame:
    """The pairs (a, b) whose whole sets link, 48 bits a shingle. A set that many pairs name goes once to every `chunk` of its partners."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    elements = whole_sets(docs, keys, named, k, lambda h: _planes(np.diff(h >> np.uint64(16), prepend=np.uint64(0))))
    many = pairs.groupBy("a").agg(F.count("*").alias("_n")).where(F.col("_n") > chunk).select("a", F.ceil(F.col("_n") / chunk).cast("int").alias("parts"))
    dealt = pairs.select("a", "b").join(many, "a", "left")
    dealt = dealt.select("a", "b", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("b"), F.col("parts"))).otherwise(0).cast("int").alias("part"))
    goes = dealt.select(F.col("b").alias("key"), "a", "part", "b").union(dealt.select(F.col("a").alias("key"), "a", "part", F.lit(None).cast("long").alias("b")).distinct())
    sent = goes.join(elements, "key").select("a", "part", "b", "elements")

    def compare(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        b = table.column("b").to_pylist()
        elements = table.column("elements")
        whole = lambda i: np.cumsum(_numbers(elements[i].as_py(), "<u8"), dtype=np.uint64)
        hub = whole(b.index(None))
        linked = []
        for i, x in enumerate(b):
            if x is not None:
                other = whole(i)
                at = np.searchsorted(hub, other)
                both = int((hub[np.minimum(at, len(hub) - 1)] == other).sum())
                if 100 * both >= percent * (len(hub) + len(other) - both):
                    linked.append(x)
        return pa.table({"a": pa.array([table.column("a")[0].as_py()] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return sent.groupBy("a", "part").applyInArrow(compare, "a long, b long")


def sketch(h: np.ndarray) -> bytes:
    """How many shingles fall to each of SKETCH_BITS places: a plane for places with one or more, one for two or more, and the rest of the counts as a number."""
    n = np.bincount((h >> np.uint64(64 - (SKETCH_BITS.bit_length() - 1))).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits(n > 0).tobytes() + np.packbits(n > 1).tobytes() + np.uint32(np.maximum(n - 2, 0).sum()).tobytes()


def most_shared(planes: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bound on the shingles that sets a and b share: the sum over places of the smaller count, and of the rests the smaller one."""
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), 1 << 15):
        x, y = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
        out[lo : lo + len(x)] = np.bitwise_count(planes[x] & planes[y]).sum(axis=1, dtype=np.int64) + np.minimum(rest[x], rest[y])
    return out


def near_in_lists(members: DataFrame, percent: int, light: int) -> DataFrame:
    """The distinct pairs (a, b), a < b, of sets of different groups in one list that may link by their sketches.

    `members` has h (the list), key, n, g (the group), c (the length of the list) and elements (a sketch). Every pair of a list meets in one cell:
    that of the list, or in a longer list that of two of its BLOCKS blocks. So a member goes to at most BLOCKS cells, and
    pairs that the bound rules out never become rows.
    """
    total = members.count()
    block = F.pmod(F.xxhash64("key", "h"), F.lit(BLOCKS))
    other = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("o")
    columns = ("h", "key", "n", "g", "elements")
    short = members.where(F.col("c") <= BLOCK_LIST).select(F.pmod(F.xxhash64("h"), F.lit(max(1, -(-total // CELL_ROWS)))).alias("cell"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("b"), *columns)
    long = members.where(F.col("c") > BLOCK_LIST).select(block.cast("int").alias("b"), other, *columns)
    long = long.select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", *columns)
    cells = short.union(long.select(F.xxhash64("h", "i", "j").alias("cell"), "i", "j", "b", *columns))

    def meet(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        h, i, j, side, key, n, g = (table.column(c).to_numpy() for c in ("h", "i", "j", "b", "key", "n", "g"))
        raw = np.frombuffer(b"".join(table.column("elements").to_pylist()), np.uint8).reshape(len(h), -1)
        planes = np.ascontiguousarray(raw[:, :-4]).view(np.uint64)
        rest = np.ascontiguousarray(raw[:, -4:]).view(np.uint32).ravel().astype(np.int64)
        order = np.lexsort((key, g, side, j, i, h))
        new = [x[order][1:] != x[order][:-1] for x in (h, i, j)]
        start = np.flatnonzero(np.concatenate([[True], new[0] | new[1] | new[2]]))
        found = [np.empty((0, 2), np.int64)]
        for lo, hi in zip(start, np.append(start[1:], len(order)), strict=True):
            rows = order[lo:hi]
            one = i[rows[0]] == j[rows[0]]
            left, right = (rows, rows) if one else (rows[side[rows] == i[rows[0]]], rows[side[rows] == j[rows[0]]])
            for at in range(0, len(left), 256):
                x = left[at : at + 256]
                small, large = np.minimum.outer(n[x], n[right]), np.maximum.outer(n[x], n[right])
                ok = np.not_equal.outer(g[x], g[right]) & (100 * small >= percent * large) & (large > light)
                if one:
                    ok &= np.less.outer(key[x], key[right])
                p, q = np.nonzero(ok)
                p, q = x[p], right[q]
                shared = most_shared(planes, rest, p, q)
                some = (100 + percent) * shared >= percent * (n[p] + n[q])
                p, q = key[p[some]], key[q[some]]
                found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return cells.groupBy("cell").applyInArrow(meet, "a long, b long").distinct()


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, key of the set and _g, the key of the group's first set, for every row of `docs` (doc_id, text)."""
    keys = cut_lineage(set_keys(docs, k))
    sizes = keys.groupBy(F.least("n_shingles", F.lit(4 * LIGHT_MOST)).alias("n")).agg(F.count("*").alias("c"), F.sum("n_shingles").alias("t")).collect()
    light = light_bound({r["n"]: r["c"] for r in sizes if r["n"]}, percent)
    total = sum(r["t"] for r in sizes)
    range_bits = min(MAP_BITS - 3, max(3, int(np.ceil(np.log2(max(1, total / RANGE_SHINGLES))))))
    maps = frequent_maps(docs, k, range_bits)
    scanned = cut_lineage(scan_lists(list_rows(docs, k, percent, light, range_bits, maps), percent, light))
    # subsets of light sets: the smallest set of a subset's list links with all that its size allows, larger ones with no others
    members = lambda kind: scanned.where(F.col("kind") == kind).select(F.col("x").alias("h"), F.col("y").alias("key"), "n", "rank")
    subs = members(2)
    least = subs.groupBy("h", "rank").agg(F.min(F.struct("n", "key")).alias("m"))
    both = subs.join(least, ["h", "rank"]).where(f"key != m.key and {100 + percent} * rank >= {percent} * (n + m.n)")
    links = both.select(F.col("m.key").alias("a"), F.col("key").alias("b"))
    # shingles in very many sets, and long lists
    long_lists = _kept(members(1).distinct())
    best = long_lists.groupBy("h").agg(F.min(F.struct("rank", "key", "n")).alias("m"))
    fits = lambda p, q: (100 * F.least(p, q) >= percent * F.greatest(p, q)) & (F.greatest(p, q) > light)
    stars = long_lists.join(best, "h").where("key != m.key").where(fits(F.col("n"), F.col("m.n")))
    few = lambda p, q: F.floor(F.least(p, q) / 32) + 1
    pairs = scanned.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("n").alias("shared"), "rank", "least").union(
        stars.select("m.key", "key", F.lit(1).cast("long"), "m.rank", few(F.col("n"), F.col("m.n"))).toDF("a", "b", "shared", "rank", "least")
    )
    pairs = _kept(pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("rank").alias("rank"), F.min("least").alias("least")))
    shared_most = pairs.select(F.explode(F.array("a", "b")).alias("key"), "shared").groupBy("key").agg(F.max("shared").alias("s"))
    # in long lists only pairs with the best member are counted, so what two sets have in long lists is added to what they share
    in_long = _kept(long_lists.groupBy("key").agg(F.count("*").alias("c")))
    zero = lambda c: F.coalesce(c, F.lit(0))

    def can_reach(p: DataFrame) -> DataFrame:
        la, lb = in_long.toDF("a", "la"), in_long.toDF("b", "lb")
        return p.join(la, "a", "left").join(lb, "b", "left").where(zero(F.col("shared")) + F.least(zero(F.col("la")), zero(F.col("lb"))) >= F.col("least")).drop("la", "lb")

    pairs = _kept(can_reach(pairs).select("a", "b", "shared", "rank"))
    chosen = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("p"), F.min_by("a", F.struct("rank", "a")).alias("q"))
    tried = _kept(chosen.select(F.explode(F.array_distinct(F.array("p", "q"))).alias("a"), "b"))
    links = _kept(links.union(verify(docs, keys, tried, k, percent)).distinct())
    groups = _kept(components(links))
    # members of long lists that can share enough with any set of a size that links
    able = long_lists.join(in_long, "key").join(shared_most, "key", "left").where(F.col("c") + zero(F.col("s")) >= few(F.ceil(F.col("n") * percent / 100), F.col("n")))
    able = _kept(able.select("h", "key", "n", "rank"))

    def split_lists() -> tuple[DataFrame, DataFrame]:
        """Group of every set, and the members of the long lists whose sets stand in more than one group, with the largest of them."""
        of = groups.select(F.col("node").alias("key"), F.col("component").alias("g"))
        tagged = able.join(of, "key", "left").withColumn("g", F.coalesce("g", "key"))
        per = tagged.groupBy("h", "g").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("g", F.struct("c", "g")).alias("main"), F.count("*").alias("gs"), F.sum("c").alias("c")).where("gs > 1")
        return of, tagged.join(per, "h")

    # sets outside of a list's main group are tried with a few of its members first
    in_order = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    _, mixed = split_lists()
    lead = mixed.where("g = main").groupBy("h").agg(F.min_by(F.struct("key", "n"), F.xxhash64("key", "h")).alias("m"))
    asks = mixed.where("g != main").join(lead, "h").where(fits(F.col("n"), F.col("m.n"))).groupBy("key").agg(F.slice(F.array_sort(F.collect_set("m.key")), 1, LEADERS).alias("k"))
    asks = in_order(asks.select(F.explode("k").alias("a"), F.col("key").alias("b")))
    asks = _kept(asks.distinct().join(in_order(tried), ["a", "b"], "left_anti"))
    tried = tried.select("a", "b").union(asks)
    if not asks.isEmpty():
        groups = _kept(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(verify(docs, keys, asks, k, percent))))
    # what is left: listed pairs in different groups that have not been tried; a set without a long list's sketch has no pair there
    of, mixed = split_lists()
    mixed = _kept(mixed.select("h", "key", "n", "g", "c"))
    sketches = whole_sets(docs, keys, mixed.select("key").distinct(), k, sketch)
    across = near_in_lists(_kept(mixed.join(sketches, "key")), percent, light)
    ga, gb = of.toDF("a", "ga"), of.toDF("b", "gb")
    apart = pairs.select("a", "b").join(ga, "a", "left").join(gb, "b", "left").where(F.coalesce("ga", "a") != F.coalesce("gb", "b"))
    left = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(across).distinct()
    left = _kept(left.join(in_order(tried), ["a", "b"], "left_anti"))
    if not left.isEmpty():
        more = verify(docs, keys, left, k, percent)
        groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    return keys.join(groups.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("_g", F.coalesce("component", "key")).drop("component")


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    A-Z are lower-cased; words are runs other than ASCII white space; the set of a text is its distinct
    windows of k words, or all its words as one if it has fewer. Texts link when
    100 * intersection >= percent * union. component_id is the smallest doc_id that links reach.

    Null and empty texts have no shingles and link with nothing; their component is their own doc_id. Rows
    without doc_id link as all others do and take the smallest doc_id of their group, or null. Repeated rows
    are copies; rows that share a doc_id but not their shingles are sets of their own. An empty table gives
    no rows; other columns are ignored. Shingles and sets are told apart by 64-bit hashes.
    """
    named = _grouped(docs.select("doc_id", "text"), k, percent)
    first = named.where("n_shingles > 0").groupBy("_g").agg(F.min("doc_id").alias("component_id"))
    out = named.join(first, "_g", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame, columns: Sequence[str], k: int = 5, percent: int = 75) -> DataFrame:
    """`columns` of one row of each group, that of the smallest doc_id; a row without doc_id only where none has one.

    Texts without shingles are no group: of their rows one stays for each doc_id, and all without doc_id.
    """
    named = _grouped(docs.select("doc_id", "text"), k, percent).where("n_shingles > 0")
    no_id = F.col("doc_id").isNull()
    first = named.groupBy("_g").agg(F.min(F.struct(no_id.alias("no_id"), "doc_id", "key")).alias("m"))
    first = _kept(first.select("m.doc_id", "m.key"))
    # texts get their keys again; whole rows are sent once, by key and doc_id, so that neither many copies nor rows without doc_id meet in one task
    rows = docs.select(F.struct(*columns).alias("_row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    none = F.lit(0).cast(docs.schema["doc_id"].dataType)
    by = lambda df: df.select("*", F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", none).alias("_id")).drop("doc_id")
    kept = by(_with_keys(rows, k).where("key != 0")).dropDuplicates(["key", "_no_id", "_id"])
    kept = kept.join(by(first), ["key", "_no_id", "_id"], "left_semi").select("_row.*")
    bare = docs.select(*columns).where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\A[\x20\x09-\x0D]*\z"))
    return kept.union(bare.where(~no_id).dropDuplicates(["doc_id"])).union(bare.where(no_id))


def oracle(k: int = 5, percent: int = 75) -> str:
    """DuckDB SQL of jaccard_groups over `documents`."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive w as materialized (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as w from documents),
s as materialized (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) end) as sh from w),
n as materialized (select doc_id, count(*) as n from s group by 1),
sets as materialized (select doc_id, md5(string_agg(sh, chr(10) order by sh)) as key from s group by 1),
reps as materialized (select key, min(doc_id) as rep from sets group by 1),
rs as materialized (select s.doc_id, s.sh from s join reps on reps.rep = s.doc_id),
o as (select x.doc_id as a, y.doc_id as b, count(*) as c from rs x join rs y on x.sh = y.sh and x.doc_id < y.doc_id group by 1, 2),
l as materialized (select a, b from o join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= {percent} * (na.n + nb.n - c)),
e as materialized (select a, b from l union select b, a from l),
r(node, c) as (select rep, rep from reps union select e.b, r.c from r join e on e.a = r.node where r.c < e.b),
g as (select node, min(c) as c from r group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(g.c, w.doc_id) as component_id
from w left join n using (doc_id) left join sets using (doc_id) left join reps on reps.key = sets.key left join g on g.node = reps.rep"""
