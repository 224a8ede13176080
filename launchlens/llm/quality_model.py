"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from launchlens.llm import words as W

#: Words are hashed to so many rows; a row is a vector of DIM. This bounds every table the driver sees.
BUCKETS, DIM, NONZERO, REACH = 1 << 14, 64, 4, 2
#: Bound of the labelled rows that the network is fitted on.
LABELLED_ROWS = 20_000
#: Documents that score less are rejected.
ACCEPT_FROM = 0.7
HIDDEN = 32


def index_vectors() -> np.ndarray:
    """Places of the NONZERO entries of every row's random index vector; even ones are +1, odd ones -1."""
    rng = np.random.default_rng(20_24)
    return np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO].astype(np.int64)


def word_rows(texts: list[bytes]) -> tuple[W.Words, np.ndarray]:
    """Runs of letters and digits and runs of marks, and the row that each hashes to."""
    w = W.split(texts, "tokens")
    return w, (w.hash >> np.uint64(64 - 14)).astype(np.int64)


def add_contexts(total: np.ndarray, w: W.Words, row: np.ndarray, index: np.ndarray) -> None:
    """Adds to each word's row the index vectors of the words up to REACH places away in its text."""
    for gap in range(1, REACH + 1):
        if len(row) <= gap:
            continue
        same = w.doc[gap:] == w.doc[:-gap]
        left, right = row[:-gap][same], row[gap:][same]
        for a, b in ((left, right), (right, left)):
            for k in range(NONZERO):
                np.add.at(total, a * DIM + index[b, k], 1 if k % 2 == 0 else -1)


def context_table(docs: DataFrame) -> np.ndarray:
    """Sums of context vectors over all words of all documents, BUCKETS x DIM.

    A task sends one row for each hashed word at most, Spark adds them up, and the driver gets the
    BUCKETS sums.
    """
    source = docs.select(F.col("text").cast("binary").alias("_text")).where("length(_text) > 0")
    names = [f"d{k}" for k in range(DIM)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, index = np.zeros(BUCKETS * DIM, np.int64), index_vectors()
        for rows in W.blocks(W.arrow_rows(batches, "_text"), 0):
            w, row = word_rows([r[0] for r in rows])
            add_contexts(total, w, row, index)
        table = total.reshape(BUCKETS, DIM)
        seen = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *(pa.array(np.ascontiguousarray(table[seen, k])) for k in range(DIM))], names=["row", *names])

    parts = source.mapInArrow(run, "row int, " + ", ".join(f"{n} long" for n in names))
    rows = parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((BUCKETS, DIM))
    out[rows["row"].to_numpy()] = rows[names].to_numpy(float)
    return out


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Unit context vectors, each with its word's own index vector, so that rare words differ too."""
    norm = np.linalg.norm(contexts, axis=1, keepdims=True)
    out = contexts / np.maximum(norm, 1e-9)
    index = index_vectors()
    own = np.zeros((BUCKETS, DIM))
    for k in range(NONZERO):
        own[np.arange(BUCKETS), index[:, k]] += (1 if k % 2 == 0 else -1) / np.sqrt(NONZERO)
    return (out + own).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text and the logarithm of its number of words."""
    w, row = word_rows(texts)
    b = w.bounds()
    n = np.diff(b)
    out = np.zeros((len(texts), DIM + 1), np.float32)
    has = np.flatnonzero(n)
    if len(has):
        out[has, :DIM] = np.add.reduceat(vectors[row], b[:-1][has], axis=0) / n[has, None]
    out[:, DIM] = np.log1p(n)
    return out


@dataclass
class Network:
    """tanh layer and logistic output over standardised inputs; logits are divided by `temperature`."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 80, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
    """Adam on logistic loss over four fifths of the rows; the rest sets the temperature by its likelihood.

    Without rows of both classes the network gives the share of ones, smoothed.
    """
    rng = np.random.default_rng(seed)
    n, width = x.shape
    mean = x.mean(axis=0) if n else np.zeros(width)
    scale = np.maximum(x.std(axis=0), 1e-3) if n else np.ones(width)
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    share = (y.sum() + 1) / (n + 2)
    net.b2 = float(np.log(share / (1 - share)))
    if n < 20 or y.min() == y.max():
        return net
    held = rng.random(n) < 0.2
    fit = np.flatnonzero(~held)
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(fit)
        lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            err = (p - y[rows]) / len(rows)
            back = np.outer(err, params[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * params[0], back.sum(axis=0), h.T @ err + decay * params[2], np.array([err.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if held.any():
        z, t = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        net.temperature = float(grid[np.argmin([np.logaddexp(0, np.where(t == 1, -z, z) / g).sum() for g in grid])])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def _features(docs: DataFrame, keys: Sequence[str], vectors: np.ndarray, network: Network | None) -> DataFrame:
    """_keys, a struct of the columns `keys`, and pooled vectors, or their scores when a network is given. Every row stays; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, None if network is None else tuple(vars(network).values())))
    source = docs.select(F.struct(*keys).alias("_keys"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    types = f"_keys {source.schema['_keys'].dataType.simpleString()}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vectors, numbers = shared.value
        network = None if numbers is None else Network(*numbers)
        for batch in batches:
            got = []
            for rows in W.blocks(W.arrow_rows([batch.select([1])], "_text"), 0, W.BLOCK_BYTES // 2):
                x = pooled([r[0] for r in rows], vectors)
                got += list(network.probability(x)) if network is not None else x.tolist()
            kind = pa.float64() if network is not None else pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], names=["_keys", "_out"])

    return source.mapInArrow(run, f"{types}, _out {'double' if network is not None else 'array<float>'}")


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Documents whose labels are never learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> Model:
    """Word vectors from all documents, the network from at most `limit` labelled ones that are not held out.

    The labelled rows are the first by a hash of doc_id; contradicting or null labels of a
    document are left out.
    """
    vectors = word_vectors(context_table(docs))
    one = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("quality").alias("_q2"))
    chosen = one.where("_q = _q2").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    # the sample is at most `limit` rows of 16 bytes
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "_q")), "doc_id")
    rows = _features(sample, ["doc_id", "_q"], vectors, None).select("_keys.*", "_out").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["_out"].tolist(), float).reshape(-1, DIM + 1)
    return Model(vectors, train(x, (rows["_q"].to_numpy() == 1).astype(float)))


def score(docs: DataFrame, model: Model, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """_keys (a struct of `keys`) and score: the probability of label 1."""
    return _features(docs, list(keys), model.vectors, model.network).withColumnRenamed("_out", "score")


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS, threshold: float = ACCEPT_FROM) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Scores depend on the text only. Null texts are empty and get the score of no words; null ids
    and repeated rows stay as they are. With too few labels the score is the share of label
    1, the same for all. An empty table gives no rows; other columns are ignored.
    """
    s = score(docs, fit(docs, labels, limit)).select("_keys.doc_id", "score")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
