"""Boosted regression trees over counted cells, and their scores.

Trees see bins of numerics and one-hot values only, so rows that agree in those are one cell. Training rows are
counted once into (cell, group), a group being one of GROUPS parts of all rows by a hash; a tree samples whole groups.
Bins bound the cells, not the input, and up to HELD_BYTES of them stay in the memory of one task, so that a fit is one job
however many trees it has. With many numerics nearly every row is a cell of its own; then they stay in Spark, a job a level.
Both ways fit the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from launchlens.operators.linear import Design
from launchlens.plans.selection import exact_quantiles, value_counts
from launchlens.session import cut_lineage

MAX_BINS = 32
#: Parts of the rows that a tree's sample is dealt from.
GROUPS = 20
#: What the counted cells that one task holds may take.
HELD_BYTES = 512 << 20
#: Rows scored at a time, so that their bins stay in the cache.
SCORE_ROWS = 4096


def cuts_of(rows: DataFrame, n_numeric: int, max_bins: int = MAX_BINS) -> list[list[float]]:
    """Per numeric of encoded rows the cuts between its bins: between all values if they are few, else exact quantiles."""
    if not n_numeric:
        return []
    counts = value_counts(rows.select(F.posexplode("_x").alias("_f", "_v")), ["_f"], "_v")
    found: list[list[float]] = [[] for _ in range(n_numeric)]
    few = {r["_f"]: r["k"] <= max_bins for r in counts.groupBy("_f").agg(F.count("*").alias("k")).collect()}
    split = {kind: [f for f, x in few.items() if x == kind] for kind in (True, False)}
    for r in counts.where(F.col("_f").isin(split[True])).orderBy("_f", "v").groupBy("_f").agg(F.sort_array(F.collect_list("v")).alias("v")).collect():
        found[r["_f"]] = [a / 2 + b / 2 for a, b in zip(r["v"], r["v"][1:])]
    if split[False]:
        parts = exact_quantiles(counts.where(F.col("_f").isin(split[False])), ["_f"], "v", [k / max_bins for k in range(1, max_bins)], weight="n")
        for r in parts.collect():
            found[r["_f"]] = sorted({float(x) for x in r[1:]})
    return found


@dataclass(frozen=True)
class Layout:
    """How encoded rows become cells: whole numbers that hold the bin of every numeric and the value of every one-hot column."""

    cuts: list[list[float]]
    #: per one-hot column its places among the values of the design
    columns: list[list[int]]
    pairs: list[tuple[int, int]]
    label_at: float = 0.0

    @staticmethod
    def of(train: DataFrame, shape: Design) -> "Layout":
        named = dict.fromkeys(c for c, _ in shape.values)
        columns = [[i for i, (c, _) in enumerate(shape.values) if c == name] for name in named]
        return Layout(cuts_of(train, len(shape.numeric)), columns, shape.pairs, shape.label_at)

    @cached_property
    def bases(self) -> list[int]:
        return [len(x) + 1 for x in (*self.cuts, *self.columns)]

    @cached_property
    def places(self) -> list[tuple[int, int]]:
        """(word, multiplier) of each number; as many share a word as 62 bits hold."""
        out, word, size = [], 0, 1
        for base in self.bases:
            if size * base > 1 << 62:
                word, size = word + 1, 1
            out.append((word, size))
            size *= base
        return out

    @property
    def words(self) -> list[str]:
        return [f"_w{k}" for k in range((self.places[-1][0] if self.places else 0) + 1)]

    @property
    def n_features(self) -> int:
        return len(self.cuts) + sum(map(len, self.columns)) + len(self.pairs)

    @property
    def widths(self) -> list[int]:
        """How many numbers there are of what has one histogram."""
        return [*self.bases, *[len(x) + 1 for x in self.crossed.values()]]

    @property
    def width(self) -> int:
        return 1 + sum(self.widths)

    def held_bytes(self, n: int) -> int:
        """What `n` counted cells take in memory, about: a row of each, and codes and bins of each different cell."""
        return 80 * n + (64 + self.n_features + 8 * len(self.widths)) * min(n, prod(self.bases))

    def cell(self) -> list[Column]:
        """The words of an encoded row."""

        def bin_of(x: str, cuts: Sequence[float], at: int = 0) -> str:
            if not cuts:
                return str(at)
            k = len(cuts) // 2
            return f"CASE WHEN {x} <= CAST('{cuts[k]!r}' AS DOUBLE) THEN {bin_of(x, cuts[:k], at)} ELSE {bin_of(x, cuts[k + 1 :], at + k + 1)} END"

        numbers = [bin_of(f"get(_x, {f})", cuts) for f, cuts in enumerate(self.cuts)]
        numbers += [f"array_position(array({', '.join(map(str, at))}), get(_codes, {k}))" for k, at in enumerate(self.columns)]
        sums: list[list[str]] = [["0L"] for _ in self.words]
        for (word, size), number in zip(self.places, numbers):
            sums[word].append(f"{size}L * CAST({number} AS BIGINT)")
        # never null, or a join on them would add a filter that works them out once more
        return [F.expr(f"coalesce({' + '.join(s)}, 0L)").alias(w) for s, w in zip(sums, self.words)]

    def counted(self, rows: DataFrame) -> DataFrame:
        """(words..., _g, n, s): rows and sum of labels, less `label_at`, of each cell and group."""
        group = F.pmod(F.xxhash64(F.lit("boost"), "_key", "label", "_x", "_codes"), F.lit(GROUPS)).cast("int").alias("_g")
        label = (F.col("label") - F.lit(self.label_at)).alias("_y")
        return rows.select(*self.cell(), group, label).groupBy(*self.words, "_g").agg(F.count("*").cast("double").alias("n"), F.sum("_y").alias("s"))

    def number(self, k: int, prefix: str = "") -> Column:
        """The k-th number of a cell in the words' columns."""
        word, size = self.places[k]
        return F.expr(f"({prefix}{self.words[word]} div {size}L) % {self.bases[k]}L")

    def flag(self, value: int, prefix: str = "") -> Column:
        """Whether a cell has the value at that place of the design."""
        k, at = next((k, at) for k, at in enumerate(self.columns) if value in at)
        return self.number(len(self.cuts) + k, prefix) == F.lit(at.index(value) + 1)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """(rows, numbers) of cells given as (rows, words)."""
        out = np.zeros((len(words), len(self.bases)), np.int64)
        for k, ((word, size), base) in enumerate(zip(self.places, self.bases)):
            out[:, k] = words[:, word] // size % base
        return out

    def fields(self, words: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(number, how many there are) of what has one histogram: numerics, one-hot columns, and the pairs of two such columns."""
        numbers = self.numbers(words)
        out = [(numbers[:, k], base) for k, base in enumerate(self.bases)]
        for (a, b), mine in self.crossed.items():
            code = np.zeros((self.bases[len(self.cuts) + a], self.bases[len(self.cuts) + b]), np.int64)
            for at, (i, j) in enumerate(mine.values(), 1):
                code[i, j] = at
            out.append((code[numbers[:, len(self.cuts) + a], numbers[:, len(self.cuts) + b]], len(mine) + 1))
        return out

    @cached_property
    def crossed(self) -> dict[tuple[int, int], dict[int, tuple[int, int]]]:
        """(column, column) -> pair -> its two numbers."""
        where = {value: (k, i) for k, at in enumerate(self.columns) for i, value in enumerate(at, 1)}
        out: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        for p, (u, v) in enumerate(self.pairs):
            (a, i), (b, j) = where[u], where[v]
            out.setdefault((a, b), {})[p] = (i, j)
        return out

    def matrix(self, words: np.ndarray) -> np.ndarray:
        """Bins and flags of cells, (rows, features): what trees compare with their cuts."""
        numbers, n = self.numbers(words), len(self.cuts)
        out = np.zeros((len(words), self.n_features), np.uint8)
        out[:, :n] = numbers[:, :n]
        for k, at in enumerate(self.columns):
            for i, value in enumerate(at, 1):
                out[:, n + value] = numbers[:, n + k] == i
        first = n + sum(map(len, self.columns))
        for p, (u, v) in enumerate(self.pairs):
            out[:, first + p] = out[:, n + u] & out[:, n + v]
        return out

    def bins(self, features: np.ndarray) -> np.ndarray:
        """The same for rows of the feature matrix."""
        out = (features > 0.5).astype(np.uint8)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.searchsorted(np.asarray(cuts, float), features[:, f], side="left")
        return out

    def candidates(self) -> list[tuple[int, int, int, int]]:
        """(feature, cut, field, number) of every split in the order of the features; a flag's right side is that number alone."""
        out = [(f, c, f, c) for f, cuts in enumerate(self.cuts) for c in range(len(cuts))]
        n = len(self.cuts)
        out += [(n + value, 0, n + k, i) for k, at in enumerate(self.columns) for i, value in enumerate(at, 1)]
        first = n + sum(map(len, self.columns))
        for field, mine in enumerate(self.crossed.values(), len(self.bases)):
            out += [(first + p, 0, field, at) for at, p in enumerate(mine, 1)]
        return sorted(out)


@dataclass(frozen=True)
class Importances:
    values: np.ndarray

    def toArray(self) -> np.ndarray:
        return self.values


@dataclass(frozen=True)
class BoostedModel:
    """Trees as full binary ones in heap order: a row goes right where its bin is above the cut."""

    layout: Layout
    #: (trees, 2 ** depth - 1)
    features: np.ndarray
    cuts: np.ndarray
    #: (trees, 2 ** depth), step size included
    leaves: np.ndarray
    gains: np.ndarray

    @property
    def featureImportances(self) -> Importances:
        return Importances(self.gains)

    def score(self, bins: np.ndarray) -> np.ndarray:
        """Predictions for rows of bins and flags."""
        out = np.full(len(bins), self.layout.label_at)
        depth, width = self.leaves.shape[1].bit_length() - 1, bins.shape[1]
        if not depth or not width:
            return out + self.leaves[:, 0].sum()
        for at in range(0, len(bins), SCORE_ROWS):
            part = np.ascontiguousarray(bins[at : at + SCORE_ROWS])
            flat, start = part.ravel(), np.arange(len(part)) * width
            total = out[at : at + SCORE_ROWS]
            for features, cuts, leaves in zip(self.features, self.cuts, self.leaves):
                node = np.zeros(len(part), np.int64)
                for _ in range(depth):
                    node += node + 1 + (flat.take(start + features.take(node)) > cuts.take(node))
                total += leaves.take(node - len(features))
        return out

    def cells(self, cells: DataFrame, toggled: str | None = None) -> DataFrame:
        """Adds prediction to different cells, dealt evenly; `toggled` names a column with the place of a flag to turn over, or -1."""
        layout, n_words, model = self.layout, len(self.layout.words), self
        spark = cells.sparkSession

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                words = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_words)]) if batch.num_rows else np.zeros((0, n_words), np.int64)
                bins = layout.matrix(words)
                if toggled is not None:
                    flag = batch.column(batch.schema.get_field_index(toggled)).to_numpy(zero_copy_only=False)
                    rows = np.flatnonzero(flag >= 0)
                    bins[rows, flag[rows]] ^= 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(bins))], names=[*batch.schema.names, "prediction"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields)
        return cells.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, f"{kinds}, prediction double")

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds prediction to rows with the words of their cells; every cell is scored once."""
        words = self.layout.words
        found = self.cells(rows.select(*words).distinct())
        return rows.join(found, words)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds prediction to rows with an array of features."""
        layout, model, at = self.layout, self, rows.columns.index("features")

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, layout.n_features)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(layout.bins(x)))], names=[*batch.schema.names, "prediction"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(run, f"{kinds}, prediction double")


class Held:
    """Counted cells in memory, with the score of each and its place in the tree at work."""

    def __init__(self, layout: Layout, words: np.ndarray, group: np.ndarray, n: np.ndarray, s: np.ndarray, score: np.ndarray | None = None):
        different, first, cell = np.unique(words, axis=0, return_index=True, return_inverse=True)
        self.cell, self.group, self.n, self.s = cell.ravel(), group, n, s
        self.size = len(different)
        # most cells having rows of most groups, a table of them adds up faster
        self.table = None
        if self.size * GROUPS <= 4 * len(n):
            at = self.group * self.size + self.cell
            self.table = [np.bincount(at, x, GROUPS * self.size).reshape(GROUPS, self.size) for x in (n, s)]
        self.score = np.zeros(self.size) if score is None else score[first]
        self.fields = layout.fields(different)
        self.bins = layout.matrix(different)
        self.flat, self.start = self.bins.ravel(), np.arange(self.size) * self.bins.shape[1]

    def begin(self, t: int, groups: np.ndarray) -> None:
        if self.table is not None:
            self.rows, sums = (x[np.sort(groups)].sum(axis=0) for x in self.table)
        else:
            weight = np.isin(np.arange(GROUPS), groups).astype(float)[self.group]
            self.rows, sums = (np.bincount(self.cell, x * weight, self.size) for x in (self.n, self.s))
        self.rest = 2.0 * (sums - self.rows * self.score) if t else sums
        self.node = np.zeros(self.size, np.int64)

    def histogram(self, level: int) -> np.ndarray:
        """(nodes, numbers, 2): rows and sums by number, the node's own first; below the root of the left one of each two nodes."""
        k, pick = max(2**level // 2, 1), slice(None)
        if level:
            pick = np.flatnonzero(self.node & 1 == 0)
        node, w = self.node[pick] >> min(level, 1), (self.rows[pick], self.rest[pick])
        codes = [(np.zeros(len(node), np.int64), 1)] + [(code[pick], base) for code, base in self.fields]
        parts = []
        for code, base in codes:
            at = node * base + code
            parts.append(np.stack([np.bincount(at, x, k * base).reshape(k, base) for x in w], axis=2))
        return np.concatenate(parts, axis=1)

    def down(self, feature: np.ndarray, cut: np.ndarray) -> None:
        self.node = 2 * self.node + (self.flat.take(self.start + feature.take(self.node)) > cut.take(self.node) if self.bins.shape[1] else 0)

    def end(self, leaves: np.ndarray) -> None:
        self.score += leaves.take(self.node)


class Spread:
    """The same over cells in Spark: a job a level, each task going through the trees since the scores were last written."""

    def __init__(self, layout: Layout, cells: DataFrame, kept_trees: int = 10):
        self.layout, self.kept_trees = layout, kept_trees
        self.cells = cut_lineage(cells.withColumn("_score", F.lit(0.0)))
        self.done: list[tuple] = []

    def begin(self, t: int, groups: np.ndarray) -> None:
        if len(self.done) == self.kept_trees:
            names = self.cells.columns
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.cells.schema.fields)

            def run(batches: Iterator) -> Iterator:
                import pyarrow as pa

                for batch, held in replayed(batches):
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held.score[held.cell])], names=names)

            replayed = self._replayed()
            self.cells = cut_lineage(self.cells.mapInArrow(run, kinds))
            self.done = []
        self.t, self.groups, self.splits = t, groups, []

    def _replayed(self):
        layout, done, n_words = self.layout, list(self.done), len(self.layout.words)

        def run(batches: Iterator) -> Iterator:
            for batch in batches:
                columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
                held = Held(layout, np.column_stack(columns[:n_words]), *columns[n_words:])
                for splits, leaves in done:
                    held.node = np.zeros(held.size, np.int64)
                    for feature, cut in splits:
                        held.down(feature, cut)
                    held.end(leaves)
                yield batch, held

        return run

    def histogram(self, level: int) -> np.ndarray:
        replayed, t, groups, splits = self._replayed(), self.t, self.groups, list(self.splits)
        shape = (max(2**level // 2, 1), self.layout.width, 2)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros(shape)
            for _, held in replayed(batches):
                held.begin(t, groups)
                for feature, cut in splits:
                    held.down(feature, cut)
                total += held.histogram(level)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["h"])

        sums = self.cells.mapInArrow(run, "h array<double>").select(F.posexplode("h").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        total = np.zeros(shape)
        total.ravel()[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
        return total

    def down(self, feature: np.ndarray, cut: np.ndarray) -> None:
        self.splits.append((feature, cut))

    def end(self, leaves: np.ndarray) -> None:
        self.done.append((self.splits, leaves))


def grown(layout: Layout, cells: Held | Spread, trees: int, depth: int, step: float, rate: float, seed: int) -> tuple[np.ndarray, ...]:
    """(features, cuts, leaves, gains) of all trees.

    As MLlib's boosting for the squared error: the first tree is fitted to the labels and has weight 1, each other one to twice
    the residuals with weight `step`; splits by the fall of the variance, the first of equal ones; leaves are means.
    """
    of_feature, of_cut, of_field, number = np.array(layout.candidates(), np.int64).reshape(-1, 4).T
    starts = np.cumsum([1, *layout.widths])
    column, ordered = starts[of_field] + number, of_field < len(layout.cuts)
    out_f, out_c = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), 255, np.int64)
    out_l, gains = np.zeros((trees, 2**depth)), np.zeros((trees, layout.n_features))
    for t in range(trees):
        cells.begin(t, np.random.default_rng([seed, t]).permutation(GROUPS)[: max(round(rate * GROUPS), 1)])
        whole = cells.histogram(0)
        ends = whole[:, 0]
        for level in range(depth if len(column) else 0):
            k = 2**level
            if level:
                left = cells.histogram(level)
                whole = np.stack([left, whole - left], axis=1).reshape(k, -1, 2)
            sums = whole.copy()
            for base, at in zip(layout.widths[: len(layout.cuts)], starts):
                sums[:, at : at + base] = np.cumsum(whole[:, at : at + base], axis=1)
            # a numeric's sums are of the left side, a flag's of the right one
            side = sums[:, column]
            a = np.where(ordered[None, :, None], side, ends[:, None] - side)
            b = ends[:, None] - a
            fits = (a[..., 0] >= 1.0) & (b[..., 0] >= 1.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                parts = a[..., 1] ** 2 / a[..., 0] + b[..., 1] ** 2 / b[..., 0]
                fall = parts - (ends[:, 1] ** 2 / ends[:, 0])[:, None]
                # what rounding leaves is no gain
                fall = np.where(fits & (fall > 1e-11 * parts), fall, -1.0)
            at, best = np.arange(k), np.argmax(fall, axis=1)
            good = fall[at, best] > 0
            feature, cut = np.where(good, of_feature[best], 0), np.where(good, of_cut[best], 255)
            out_f[t, k - 1 : 2 * k - 1], out_c[t, k - 1 : 2 * k - 1] = feature, cut
            np.add.at(gains[t], feature[good], fall[at, best][good])
            down = np.where(good[:, None], a[at, best], ends)
            ends = np.stack([down, ends - down], axis=1).reshape(2 * k, 2)
            cells.down(feature, cut)
        out_l[t, : len(ends)] = np.where(ends[:, 0] > 0.5, ends[:, 1] / np.maximum(ends[:, 0], 1.0), 0.0) * (step if t else 1.0)
        cells.end(out_l[t])
    return out_f, out_c, out_l, gains


@dataclass(frozen=True)
class GBTRegressor:
    """MLlib's boosted regression trees for the squared error, with the cells of a layout for rows and groups of rows for its samples."""

    layout: Layout
    maxIter: int = 20
    maxDepth: int = 5
    stepSize: float = 0.1
    subsamplingRate: float = 1.0
    seed: int = 0

    def fit(self, dataset: DataFrame, params: dict | None = None) -> BoostedModel:
        """The model of counted cells."""
        layout, n_words = self.layout, len(self.layout.words)
        settings = (self.maxIter, self.maxDepth, self.stepSize, self.subsamplingRate, self.seed)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            table = [[x.to_numpy(zero_copy_only=False) for x in batch.columns] for batch in batches if batch.num_rows]
            kinds = [np.int64] * n_words + [np.int32, float, float]
            columns = [np.concatenate([part[k] for part in table]) if table else np.zeros(0, kind) for k, kind in enumerate(kinds)]
            del table
            found = grown(layout, Held(layout, np.column_stack(columns[:n_words]), *columns[n_words:]), *settings)
            yield pa.RecordBatch.from_arrays([pa.array(range(4), pa.int32()), pa.array([x.astype(float).tobytes() for x in found], pa.binary())], names=["k", "v"])

        if layout.held_bytes(dataset.count()) <= HELD_BYTES:
            held = dataset.repartition(1).mapInArrow(run, "k int, v binary").collect()
            features, cuts, leaves, gains = (np.frombuffer(r["v"]).reshape(self.maxIter, -1) for r in sorted(held, key=lambda r: r["k"]))
        else:
            features, cuts, leaves, gains = grown(layout, Spread(layout, dataset), *settings)
        share = gains.sum(axis=0)
        return BoostedModel(layout, features.astype(np.int64), cuts.astype(np.int64), leaves, share / max(share.sum(), 1e-300))
