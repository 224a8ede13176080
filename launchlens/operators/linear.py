"""Feature matrices of numerics, one-hot values and pairs of them, and linear fits from their cross-product sums.

One pass over the encoded rows gives a Gram matrix per fold. Everything linear comes
from those: least squares, the whole ridge and lasso paths with cross-validation, errors and
permutation importance. The Gram of a training part is the total less the folds left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from launchlens.operators.mining import onehot_support
from launchlens.plans.selection import exact_medians
from launchlens.session import cut_lineage

#: Numbers of one dense block of the feature matrix inside a task.
BLOCK_CELLS = 1 << 21


@dataclass(frozen=True)
class Design:
    """Columns of a feature matrix, in this order: numerics, one-hot values, pairs of one-hot values."""

    #: numeric column -> what stands for a missing value
    numeric: dict[str, float]
    #: (column, value), nulls being the value 'NA'
    values: list[tuple[str, str]]
    #: places in `values`
    pairs: list[tuple[int, int]]
    #: a value amid the target's, so that sums of products keep their digits
    label_at: float = 0.0

    @property
    def names(self) -> list[str]:
        flags = [f"{c}={v}" for c, v in self.values]
        return [*self.numeric, *flags, *[f"{flags[a]}&{flags[b]}" for a, b in self.pairs]]

    def encode(self) -> tuple[Column, Column]:
        """(numbers, codes): filled numerics, and the places of the row's one-hot values, -1 for a value without a column."""
        numbers = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(m)).otherwise(F.col(c).cast("double")) for c, m in self.numeric.items()]
        codes = []
        for column in dict.fromkeys(c for c, _ in self.values):
            at = [i for i, (c, _) in enumerate(self.values) if c == column]
            listed = F.array(*[F.lit(self.values[i][1]) for i in at])
            place = F.array_position(listed, F.coalesce(F.col(column).cast("string"), F.lit("NA")))
            codes.append(F.coalesce(F.get(F.array(*[F.lit(i) for i in at]), (place - 1).cast("int")), F.lit(-1)))
        empty = lambda kind: F.array().cast(f"array<{kind}>")
        return (F.array(*numbers) if numbers else empty("double")), (F.array(*codes) if codes else empty("int"))

    def features(self, numbers: str = "_x", codes: str = "_codes") -> Column:
        """The row of the feature matrix as array<double>, from encoded rows."""
        flags = [F.array_contains(codes, i).cast("double") for i in range(len(self.values))]
        both = [(F.array_contains(codes, a) & F.array_contains(codes, b)).cast("double") for a, b in self.pairs]
        return F.concat(F.col(numbers), F.array(*flags, *both)) if flags else F.col(numbers)

    def matrix(self, numbers: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The same rows in numpy."""
        n = len(numbers)
        flags = np.zeros((n, len(self.values) + 1))
        flags[np.arange(n)[:, None], codes] = 1.0
        flags = flags[:, :-1]
        a, b = (np.array([p[k] for p in self.pairs], np.int64) for k in (0, 1))
        return np.concatenate([numbers, flags, flags[:, a] * flags[:, b]], axis=1)


def design(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], min_support: float = 0.03, pairs: DataFrame | None = None) -> Design:
    """Medians, values with enough support, and the pairs that `interactions` found among those.

    At most 1 / min_support values per column reach the driver, and the pairs.
    """
    kept = onehot_support(df, categorical, min_support).orderBy("column", F.col("n").desc(), "value").collect() if categorical else []
    values = [(r["column"], r["value"]) for r in kept]
    place = {f"{c}={v}": i for i, (c, v) in enumerate(values)}
    both = pairs.orderBy("rank_a", "rank_b").select("a", "b").collect() if pairs is not None else []
    medians = exact_medians(df, list(dict.fromkeys([*numeric, target])))
    chosen = [(place[r["a"]], place[r["b"]]) for r in both if r["a"] in place and r["b"] in place]
    return Design({c: medians.get(c, 0.0) for c in numeric}, values, chosen, medians.get(target, 0.0))


def encode_rows(df: DataFrame, shape: Design, target: str, keep: Sequence[str | Column]) -> DataFrame:
    """(keep..., label, _x, _codes) of the rows with a target."""
    numbers, codes = shape.encode()
    return df.where(F.col(target).isNotNull()).select(*keep, F.col(target).cast("double").alias("label"), numbers.alias("_x"), codes.alias("_codes"))


@dataclass(frozen=True)
class Gram:
    """Sums of products of (1, features, label), all less `shift`, over some rows."""

    sums: np.ndarray
    shift: np.ndarray

    def __sub__(self, other: "Gram") -> "Gram":
        return Gram(self.sums - other.sums, self.shift)

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.sums + other.sums, self.shift)

    @property
    def n(self) -> float:
        return float(self.sums[0, 0])

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of products of the distances from the means, and the means (less shift), of features and label."""
        mean = self.sums[0, 1:] / max(self.n, 1.0)
        return self.sums[1:, 1:] - self.n * np.outer(mean, mean), mean

    def intercept(self, w: np.ndarray) -> float:
        mean = self.sums[0, 1:] / max(self.n, 1.0) + self.shift
        return float(mean[-1] - mean[:-1] @ w)

    def mse(self, w: np.ndarray, intercept: float) -> float:
        """Mean squared error of a linear model on these rows."""
        inner = intercept + self.shift[:-1] @ w - self.shift[-1]
        u = np.concatenate([[-inner], -w, [1.0]])
        return max(float(u @ self.sums @ u) / max(self.n, 1.0), 0.0)

    def r2(self, w: np.ndarray, intercept: float) -> float:
        square, _ = self.centred()
        return 1.0 - self.mse(w, intercept) * self.n / square[-1, -1] if square[-1, -1] > 0 else 0.0


def grams(rows: DataFrame, shape: Design, fold: Column, n_folds: int) -> list[Gram]:
    """One Gram per fold number from 0, in one pass; rows of other numbers are left out.

    A task adds up its rows and sends the upper triangles, which Spark sums; what reaches
    the driver is n_folds * (features + 2) ** 2 / 2 numbers, whatever the rows.
    """
    shift = np.concatenate([list(shape.numeric.values()), np.zeros(len(shape.values) + len(shape.pairs)), [shape.label_at]])
    m = len(shift) + 1
    n_codes = len(dict.fromkeys(c for c, _ in shape.values))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((n_folds, m, m))
        step = max(BLOCK_CELLS // m, 1)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                k = part.num_rows
                numbers = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(k, len(shape.numeric))
                codes = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(k, n_codes)
                x = np.concatenate([shape.matrix(numbers, codes), part.column(1).to_numpy(zero_copy_only=False)[:, None]], axis=1) - shift
                x = np.concatenate([np.ones((k, 1)), x], axis=1)
                of = part.column(0).to_numpy(zero_copy_only=False)
                for f in range(n_folds):
                    mine = x[of == f]
                    total[f] += mine.T @ mine
        f, i = (a.ravel() for a in np.meshgrid(np.arange(n_folds), np.arange(m), indexing="ij"))
        lines = [total[a, b, b:] for a, b in zip(f, i)]
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(i, pa.int32()), pa.array(lines, pa.list_(pa.float64()))], names=["fold", "i", "line"])

    partial = rows.select(fold.cast("int").alias("_fold"), "label", "_x", "_codes").mapInArrow(run, "fold int, i int, line array<double>")
    cells = partial.select("fold", "i", F.posexplode("line").alias("j", "s")).groupBy("fold", "i", "j").agg(F.sum("s").alias("s")).toArrow()
    sums = np.zeros((n_folds, m, m))
    f, i, j, s = (cells.column(c).to_numpy() for c in ("fold", "i", "j", "s"))
    sums[f, i, i + j] = s
    sums[f, i + j, i] = s
    return [Gram(g, shift) for g in sums]


def least_squares(g: Gram) -> np.ndarray:
    """Coefficients with the least squared error; of several such the ones with the least square sum.

    Columns are scaled to unit length before directions without variance are told apart.
    """
    square, _ = g.centred()
    s, c = square[:-1, :-1], square[:-1, -1]
    scale = np.sqrt(np.maximum(np.diag(s), 0.0))
    scale[scale <= 1e-9 * max(scale.max(initial=0.0), 1e-300)] = np.inf
    values, vectors = np.linalg.eigh(s / np.outer(scale, scale))
    solid = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    v = vectors[:, solid]
    w = (v @ ((v.T @ (c / scale)) / values[solid])) / scale
    free = vectors[:, ~solid] / np.where(np.isinf(scale), 1.0, scale)[:, None]
    if free.shape[1]:
        basis, _ = np.linalg.qr(free)
        w = w - basis @ (basis.T @ w)
    return w


def ridge_path(g: Gram, penalties: Sequence[float]) -> np.ndarray:
    """Coefficients for each penalty on their summed squares, from one decomposition of the Gram."""
    square, _ = g.centred()
    values, vectors = np.linalg.eigh(square[:-1, :-1])
    inner = vectors.T @ square[:-1, -1]
    solid = values > 1e-13 * max(values.max(initial=0.0), 1e-300)
    # directions without variance have no product with the label but for rounding
    inner = np.where(solid, inner, 0.0)
    return np.array([vectors @ (inner / (np.where(solid, values, 0.0) + a)) for a in penalties])


def lasso_path(parts: Sequence[Gram], penalties: Sequence[float], tolerance: float = 1e-9, sweeps: int = 10_000) -> np.ndarray:
    """Coefficients (part, penalty, feature) for each penalty on the summed sizes, of half the mean squared error.

    Coordinate descent on the Grams of all parts side by side, from the largest penalty down, each from
    the solution before. A step ends when no coefficient moves the prediction by more than
    `tolerance` of the label's spread.
    """
    centred = [(g.centred()[0], max(g.n, 1.0)) for g in parts]
    s = np.array([q[:-1, :-1] / n for q, n in centred])
    c = np.array([q[:-1, -1] / n for q, n in centred])
    spread = np.sqrt(np.maximum([q[-1, -1] / n for q, n in centred], 0.0)) + 1e-300
    size = np.maximum(np.einsum("pii->pi", s), 0.0)
    live = size > 1e-18 * np.maximum(size.max(axis=1, keepdims=True, initial=0.0), 1e-300)
    p = s.shape[1]
    w = np.zeros((len(parts), p))
    out = np.zeros((len(parts), len(penalties), p))
    for k in np.argsort(-np.asarray(penalties), kind="stable"):
        a = penalties[k]
        active = np.arange(p)
        for _ in range(sweeps):
            moved = 0.0
            for j in active:
                rho = c[:, j] - np.einsum("pi,pi->p", s[:, j], w) + size[:, j] * w[:, j]
                new = np.where(live[:, j], np.sign(rho) * np.maximum(np.abs(rho) - a, 0.0) / np.where(live[:, j], size[:, j], 1.0), 0.0)
                moved = max(moved, float((np.abs(new - w[:, j]) * np.sqrt(size[:, j]) / spread).max()))
                w[:, j] = new
            if moved <= tolerance:
                if len(active) == p:
                    break
                active = np.arange(p)
            elif len(active) == p:
                # settle the features in use before looking at all again
                active = np.flatnonzero((w != 0).any(axis=0))
                active = active if len(active) else np.arange(p)
        out[:, k] = w
    return out


def cross_validated(total: Gram, folds: Sequence[Gram], kind: str, penalties: Sequence[float]) -> tuple[np.ndarray, float]:
    """(coefficients, penalty) with the least mean squared error over the folds; ties take the earlier penalty."""
    training = [total - f for f in folds]
    paths = lasso_path([*training, total], penalties) if kind == "lasso" else np.array([ridge_path(g, penalties) for g in [*training, total]])
    errors = np.zeros(len(penalties))
    for path, train, left_out in zip(paths, training, folds):
        if left_out.n and train.n:
            errors += [left_out.mse(w, train.intercept(w)) for w in path]
    best = int(np.argmin(errors))
    return paths[-1][best], float(penalties[best])


@dataclass(frozen=True)
class LinearFit:
    """Coefficients of a feature matrix."""

    coefficients: np.ndarray
    intercept: float

    def predict(self, features: Column | str) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in self.coefficients]) if len(self.coefficients) else F.array().cast("array<double>")
        return F.aggregate(F.zip_with(features, weights, lambda x, w: x * w), F.lit(float(self.intercept)), lambda a, x: a + x)

    def permuted_mse(self, g: Gram) -> np.ndarray:
        """Expected mean squared error on the rows of `g` when one feature is dealt to rows at random, per feature."""
        square, _ = g.centred()
        n, w = max(g.n, 1.0), self.coefficients
        # products of each feature with the residual, both from their means
        residual = (square[:-1, -1] - square[:-1, :-1] @ w) / n
        return self.mse(g) + 2 * w * residual + 2 * w * w * np.diag(square[:-1, :-1]) / n

    def mse(self, g: Gram) -> float:
        return g.mse(self.coefficients, self.intercept)


def folds_of(key: str, n: int, seed: str = "price") -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(n)).cast("int")


def kept_rows(df: DataFrame, shape: Design, target: str, key: str, held_out: Column, folds: int) -> DataFrame:
    """Encoded rows, written once, with _fold: 0 for held-out rows, 1 to `folds` for the others."""
    held = F.coalesce(held_out.cast("boolean"), F.lit(False))
    number = F.when(held, F.lit(0)).otherwise(folds_of(key, folds) + 1).alias("_fold")
    return cut_lineage(encode_rows(df, shape, target, [F.col(key).alias("_key"), number]))
