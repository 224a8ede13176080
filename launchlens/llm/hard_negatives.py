"""Hard-negative mining: a secondary-sort shuffle of packed pair scores, read by a streaming iterator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from launchlens.session import cut_lineage

#: Rows of one chunk and anchors of one block: a task scores one block against one chunk.
CHUNK_ROWS, BLOCK_ANCHORS = 8192, 2048
#: Anchors scored at once inside a task; the work arrays hold this many times CHUNK_ROWS numbers.
TILE_ANCHORS = 128
POSITIVE, NEGATIVE = 0, 1
#: (anchor, descending score, kind, id), big-endian with the sign bit flipped, so that bytes sort as the numbers do.
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
SIGN = np.uint64(1 << 63)


def pack_keys(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray):
    """Sort keys as an Arrow binary array. At equal scores positives come before negatives."""
    import pyarrow as pa

    out = np.empty(len(anchor), KEY)
    out["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ SIGN
    out["score"] = ~(score.astype(np.int64).view(np.uint64) ^ SIGN)
    out["kind"] = kind
    out["id"] = ids.astype(np.int64).view(np.uint64) ^ SIGN
    offsets = np.arange(len(out) + 1, dtype=np.int32) * KEY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def unpack_keys(keys) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, score, kind, id) of packed keys."""
    rows = np.frombuffer(b"".join(keys.to_pylist()), KEY)
    signed = [(rows[c].astype(np.uint64) ^ SIGN).view(np.int64).tolist() for c in ("anchor", "id")]
    score = (~rows["score"].astype(np.uint64) ^ SIGN).view(np.int64).tolist()
    return zip(signed[0], score, rows["kind"].tolist(), signed[1], strict=True)


def integer_codes(vectors, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of every component as integers; shorter vectors are filled with zeros."""
    import pyarrow as pa
    import pyarrow.compute as pc

    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(values) and np.abs(values).max() >= 2.0**62:
        raise OverflowError("vector components past 64 bits")
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return values.astype(np.int64).reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values.astype(np.int64)
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> Callable[[int, int], np.ndarray]:
    """Exact products of rows lo:hi of `a` with all rows of `b`, in the narrowest type that holds every partial sum."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(width, 1)
    if bound >= 1 << 63:
        raise OverflowError("inner products past 64 bits")
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    a, b = a.astype(kind), np.ascontiguousarray(b.astype(kind).T)
    return lambda lo, hi: a[lo:hi] @ b


def first_of(scores: np.ndarray, open_pairs: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k highest open pairs of each row, ties by the smaller column."""
    low = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
    masked = np.where(open_pairs, scores, scores.dtype.type(low))
    if scores.shape[1] <= k:
        return open_pairs
    least = np.partition(masked, -k, axis=1)[:, -k, None]
    above = open_pairs & (masked > least)
    ties = open_pairs & (masked == least)
    return above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)))


def _layers(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers in runs without a repeated id, each in the order of ids; one run unless ids repeat."""
    order = np.argsort(ids, kind="stable")
    new = np.concatenate([[True], np.diff(ids[order]) != 0]) if len(ids) else np.zeros(0, bool)
    at = np.arange(len(ids))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    for n in range(int(nth.max(initial=-1)) + 1):
        yield order[nth == n]


def _pairs(anchors, rows, chosen: Callable[[np.ndarray, np.ndarray, slice], np.ndarray], kind: int):
    """Packed keys of the pairs of one block and one chunk that `chosen(scores, same label, anchors)` marks."""
    import pyarrow as pa

    made = []
    if anchors.num_rows and rows.num_rows:
        a_id, a_label = (anchors.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        r_id, r_label = (rows.column(c).to_numpy().astype(np.int64) for c in ("row", "row_label"))
        a_codes, r_codes = integer_codes(anchors.column("vector")), integer_codes(rows.column("row_vector"))
        for layer in _layers(r_id):
            product = inner_products(a_codes, r_codes[layer])
            for lo in range(0, len(a_id), TILE_ANCHORS):
                part = slice(lo, min(lo + TILE_ANCHORS, len(a_id)))
                scores = product(part.start, part.stop)
                same = a_label[part, None] == r_label[None, layer]
                if kind == POSITIVE:
                    same &= a_id[part, None] != r_id[None, layer]
                i, j = np.nonzero(chosen(scores, same, part))
                made.append((a_id[part][i], scores[i, j].astype(np.int64), r_id[layer][j]))
    a, s, r = (np.concatenate(x) for x in zip(*made)) if made else (np.empty(0, np.int64),) * 3
    return pa.table({"anchor": a, "key": pack_keys(a, s, kind, r)})


def _block_positives(k: int) -> Callable:
    def run(anchors, rows):
        return _pairs(anchors, rows, lambda scores, same, _: first_of(scores, same, k), POSITIVE)

    return run


def _block_negatives(k: int, low: int, scale: int) -> Callable:
    """Marks what any window of an anchor could return: the first k of this chunk inside each window."""

    def run(anchors, rows):
        windows = anchors.column("windows").to_pylist()

        def chosen(scores, same, part):
            out = np.zeros(same.shape, bool)
            held = windows[part]
            for n in range(max(map(len, held))):
                # an anchor with fewer windows gets an empty one
                high = np.array([w[n] if n < len(w) else 0 for w in held], object)
                least = np.array([-(-low * w[n] // scale) if n < len(w) else 1 for w in held], object)
                high, least = (x.astype(scores.dtype)[:, None] for x in (high, least))
                out |= first_of(scores, ~same & (scores >= least) & (scores <= high), k)
            return out

        return _pairs(anchors, rows, chosen, NEGATIVE)

    return run


def secondary_sort(pairs: DataFrame) -> DataFrame:
    """One shuffle by anchor whose partitions are sorted by the packed key: repartitionAndSortWithinPartitions in DataFrame form."""
    return pairs.select("anchor", "key").repartition("anchor").sortWithinPartitions("key")


def _stream_positives(k: int) -> Callable:
    """The first k different pairs of each anchor, as they come."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, last, left = None, None, 0
        for batch in batches:
            got = []
            for pair in unpack_keys(batch.column(1)):
                if pair == last:
                    continue
                if pair[0] != now:
                    now, left = pair[0], k
                last = pair
                if left:
                    left -= 1
                    got.append(pair)
            a, s, _, i = (np.array(x, np.int64) for x in zip(*got)) if got else (np.empty(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(i), pa.array(s), pack_keys(a, s, POSITIVE, i)], names=["anchor", "positive", "score", "key"])

    return run


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _stream_negatives(k: int, low: int, scale: int) -> Callable:
    """Positives open windows, negatives go to every open one; what is held is one anchor's open windows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in MINED.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        now, last, windows = None, None, []
        for batch in batches:
            got = []
            for pair in unpack_keys(batch.column(1)):
                if pair == last:
                    continue
                last = pair
                anchor, score, kind, i = pair
                if anchor != now:
                    now, windows = anchor, []
                if kind == POSITIVE:
                    windows.append([i, score, 0])
                    continue
                windows = [w for w in windows if w[2] < k and low * w[1] <= scale * score]
                for w in windows:
                    w[2] += 1
                    got.append((anchor, w[0], w[2], i, w[1], score))
            columns = list(zip(*got)) if got else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def _usable(vectors: DataFrame) -> DataFrame:
    """(id, label, vector) of the rows that take part, equal rows once."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where("id is not null and label is not null and vector is not null").where(fine).distinct()


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 100, chunk_rows: int = CHUNK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """Hard negatives of every anchor and each of its positives.

    `vectors` has id, label and vector (array of numbers); `is_anchor` is a condition on them. A pair's
    score is the inner product of floor(256 * x); higher scores come first, ties by smaller id. The
    positives of an anchor are the first `positives` other ids of its label; the negatives of a positive with score p
    are the first `negatives` rows of other labels with a score from p * low / scale up to p.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors in blocks meet all rows in chunks, chosen by a hash of the id, so a task scores a bounded number of
    pairs and sends only the first of its chunk: at first those of the same label, and, once the windows
    are known, of each window. The packed keys go through one shuffle by anchor, sorted inside partitions,
    and an iterator reads the stream; it holds one anchor's open windows. A pair is scored in one of the two passes.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Equal rows count
    once. Rows of one id that differ each take part; as anchors their pairs are united, and a negative or positive with
    two scores stands twice. Shorter vectors are filled with zeros. Anchors without positives, and
    positives with an empty window (any with a negative score), give no rows; so does an empty table. Scores past 64
    bits are an error. Other columns are ignored.
    """
    rows = cut_lineage(_usable(vectors.select("id", "label", "vector")).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector"))
    anchors = rows.where(is_anchor)
    n_chunks, n_blocks = (max(-(-df.count() // size), 1) for df, size in ((rows, chunk_rows), (anchors, block_anchors)))

    def part(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "id", "vector"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt = rows.select(F.col("id").alias("row"), F.col("label").alias("row_label"), F.col("vector").alias("row_vector"), part(n_chunks, 1).alias("_c"))
    chunks = dealt.withColumn("_b", every(n_blocks)).groupBy("_b", "_c")

    def scored(of: DataFrame, run: Callable) -> DataFrame:
        blocks = of.withColumns({"_block": part(n_blocks, 2), "_chunk": every(n_chunks)}).groupBy("_block", "_chunk")
        return blocks.cogroup(chunks).applyInArrow(run, "anchor long, key binary")

    found = secondary_sort(scored(anchors, _block_positives(positives))).mapInArrow(_stream_positives(positives), "anchor long, positive long, score long, key binary")
    found = cut_lineage(found)
    windows = found.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("windows"))
    open_pairs = scored(anchors.join(windows, "id"), _block_negatives(negatives, low, scale))
    return secondary_sort(found.select("anchor", "key").union(open_pairs)).mapInArrow(_stream_negatives(negatives, low, scale), MINED)


def oracle(positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 100) -> str:
    """DuckDB SQL for the registered query."""
    return f"""
    WITH v AS (
      SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS codes
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
      SELECT DISTINCT a.id AS anchor_id, r.id, a.label = r.label AS same, list_dot_product(a.codes, r.codes)::BIGINT AS score
      FROM v a JOIN v r ON a.id % 100 = 0
    ), pos AS (
      SELECT * FROM pairs WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {positives}
    ), hits AS (
      SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id, p.score ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
      FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND {low} * p.score <= {scale} * n.score AND n.score <= p.score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM hits WHERE rank <= {negatives}"""
