"""Byte-level BPE by rank tables: encoding with a bitmap rank queue, and decoding."""

from __future__ import annotations

import hashlib
import sys
import types
import uuid
from collections.abc import Iterator
from heapq import heappop, heappush

from pyspark.sql import DataFrame, SparkSession, functions as F

from launchlens.llm import words as W

#: Pre-tokens kept with their ids in a Python worker; those longer than MEMO_BYTES are encoded anew.
MEMO, MEMO_BYTES = 1_000_000, 64
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Merger:
    """Merges of one rank table, with a queue of positions by rank.

    The queue has a bucket of linked-list positions for each rank that waits, the leftmost first, and a
    bitmap of two levels, 256 ranks to a word: a set bit in `low` is a rank with a bucket, a set bit in the
    word above it a word of `low` with a bit. Find-first-set on the way down names the next
    rank. It is empty between calls, so its words are reused.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.low = [0] * (max(ranks.values(), default=0) // 256 + 1)
        self.bits = [1 << k for k in range(max(256, len(self.low)))]

    def __call__(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        Parts are a linked list over byte positions. The queue holds, for a part, the rank of the
        merge with the part after it; an entry is stale, and skipped, when that pair's
        rank is no longer the entry's. Each merge queues at most two new pairs, so the
        work is in proportion to the length.
        """
        ranks, low, bits = self.ranks, self.low, self.bits
        get = ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        buckets: dict[int, list[int]] = {}
        top = 0
        for i, r in enumerate(pair):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    low[r >> 8] |= bits[r & 255]
                    top |= bits[r >> 8]
        while top:
            group = (top & -top).bit_length() - 1
            word = low[group]
            rank = (group << 8) + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[group] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            pair[j] = -1
            if k < n:
                before[k] = i
                r = pair[i] = get(piece[i : after[k]], -1)
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        low[r >> 8] |= bits[r & 255]
                        top |= bits[r >> 8]
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = get(piece[h:k], -1)
                if r != pair[h]:
                    pair[h] = r
                    if r >= 0:
                        if r in buckets:
                            heappush(buckets[r], h)
                        else:
                            buckets[r] = [h]
                            low[r >> 8] |= bits[r & 255]
                            top |= bits[r >> 8]
        ids, i = [], 0
        while i < n:
            j = after[i]
            ids.append(ranks[piece[i:j]])
            i = j
        return ids


class Memo(dict):
    """Pre-token -> its decimal ids joined by commas. Two generations, so that common ones stay."""

    def __init__(self, merge: Merger):
        self.merge, self.old = merge, {}

    def __missing__(self, token: str) -> str:
        got = self.old.get(token)
        if got is None:
            got = ",".join(map(str, self.merge(token.encode())))
            if len(token) > MEMO_BYTES:
                return got
        if len(self) >= MEMO // 2:
            self.old = dict(self)
            self.clear()
        self[token] = got
        return got


class Codec:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.memo = Memo(Merger(ranks))
        self.back = {str(v): k for k, v in ranks.items()}

    def encode(self, text: str) -> str:
        """Decimal ids of a whole text, joined by commas."""
        return ",".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.back.__getitem__, ids.split(","))) if ids else b""


def worker_codec(token: str, ranks: dict[bytes, int], pattern: str) -> Codec:
    """The codec of this Python process for one call of encode_texts, so that its memory of pre-tokens outlives a task.

    The functions of a task are unpickled anew for each, so the holder stands among the loaded modules.
    """
    holder = sys.modules.setdefault("launchlens_worker_codec", types.ModuleType("launchlens_worker_codec"))
    kept = vars(holder).get("kept")
    if kept is None or kept[0] != token:
        kept = holder.kept = (token, Codec(ranks, pattern))
    return kept[1]


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank on each line."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids.

    ids is the list of token ids of the whole text, each match of `pattern` merged by itself, no
    special tokens. decoded_sha256 is of the bytes that the ids decode to.

    Null texts are empty: no ids, the digest of nothing. Null ids and repeated rows stay as they
    are; an empty table gives no rows; other columns are ignored. The rank table is a fixed
    vocabulary of about a megabyte, read by the driver and sent to every worker once.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    token = uuid.uuid4().hex
    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {SCHEMA}" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = worker_codec(token, shared.value, pattern)
        for batch in batches:
            for rows in W.blocks(W.arrow_rows([batch], "doc_id", "_text"), 1, 4 << 20):
                n, ids_sha, back_sha, lists = [], [], [], []
                for _, text in rows:
                    ids = codec.encode(text)
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    back_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if with_ids:
                        lists.append([int(x) for x in ids.split(",")] if ids else [])
                got = [pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(back_sha)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    got.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(got, names=names)

    return source.mapInArrow(run, schema)
