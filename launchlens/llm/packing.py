"""Packing by length: bucket boundaries from a histogram, token-budget batches inside each bucket."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F


#: Words stand for tokens unless the caller has a token count.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def optimal_buckets(lengths: Sequence[int], counts: Sequence[int], n_buckets: int) -> list[int]:
    """Upper bounds of at most `n_buckets` buckets with the least padding over the histogram.

    best(k, j) = min over i < j of best(k - 1, i) + bound(j) * rows(i, j): padding is the
    padded total less the fixed sum of lengths. The best split point does not move left as j grows,
    so each layer is filled by halving, in layers * bins * log(bins) steps. The last bound is the
    largest length; ties take the smaller split.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)])
    best = np.concatenate([[0], lengths * rows[1:]]).astype(np.int64)
    splits = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(n_buckets, n)):
        nxt, at = best.copy(), np.zeros(n + 1, np.int64)
        work = [(1, n, 0, n - 1)]
        while work:
            lo, hi, a, b = work.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (rows[j] - rows[i])
            k = int(np.argmin(cost))
            nxt[j], at[j] = cost[k], i[k]
            work += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        splits.append(at)
        best = nxt
    bounds, j = [], n
    for at in reversed(splits):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(at[j])
    return sorted(bounds)


def pieces(docs: DataFrame, max_tokens: int, tokens: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens): texts longer than `max_tokens` in runs of that many, the last one shorter."""
    n = F.coalesce(tokens, F.lit(0)).cast("long") if tokens is not None else n_words(F.col("text"))
    whole = docs.select("doc_id", n.alias("_n"))
    last = F.greatest(F.ceil(F.col("_n") / F.lit(max_tokens)), F.lit(1)) - 1
    return whole.select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id",
        "piece",
        (F.col("piece") * max_tokens).alias("start"),
        F.least(F.lit(max_tokens).cast("long"), F.col("_n") - F.col("piece") * max_tokens).alias("n_tokens"),
    )


def pack(docs: DataFrame, max_tokens: int = 2048, n_buckets: int = 16, batch_tokens: int = 65_536, slice_rows: int = 100_000, tokens: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket_tokens, batch, slot, padding.

    A bucket holds the lengths up to bucket_tokens and above the next smaller bound; batch b
    of a bucket has batch_tokens // bucket_tokens slots (one at least), filled in the order of length, a hash of
    doc_id, doc_id and piece. `tokens` replaces the word count.

    The histogram has at most max_tokens + 1 bins, whatever the input, and it alone reaches
    the driver. Places are numbered in slices: a slice is a length and so many hash ranges of it
    that about `slice_rows` rows meet in a task, and the sizes of the slices before give its offset.

    Null and empty texts have one piece of no tokens, in the first bucket; null ids are kept;
    repeated rows get slots of their own; an empty table gives no rows; other
    columns are ignored.
    """
    p = pieces(docs, max_tokens, tokens)
    hist = p.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()
    bounds = optimal_buckets([h["n_tokens"] for h in hist], [h["n"] for h in hist], n_buckets) or [max_tokens]
    n_slices = {h["n_tokens"]: -(-h["n"] // slice_rows) for h in hist if h["n"] > slice_rows}
    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bucket)
    cuts = F.lit(1)
    for size, k in n_slices.items():
        cuts = F.when(F.col("n_tokens") == size, F.lit(k)).otherwise(cuts)
    h = F.xxhash64(F.col("doc_id").cast("string"))
    part = F.floor((h / F.lit(2.0**64) + 0.5) * cuts).cast("int")
    p = p.withColumns({"bucket_tokens": bucket.cast("long"), "_h": h, "_s": part})
    sizes = p.groupBy("bucket_tokens", "n_tokens", "_s").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("bucket_tokens").orderBy("n_tokens", "_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("n_tokens", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("n_tokens", "_s").orderBy("_h", "doc_id", "piece")
    placed = p.withColumn("_rn", F.row_number().over(inside) - 1).join(offsets, ["n_tokens", "_s"])
    slots = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket_tokens"), F.lit(1))).cast("long"))
    place = (F.col("_off") + F.col("_rn")).cast("long")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "n_tokens",
        "bucket_tokens",
        F.floor(place / slots).cast("long").alias("batch"),
        (place % slots).cast("long").alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
