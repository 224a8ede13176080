"""Many logistic models fitted together: every row adds to all the models it belongs to, one pass a step.

The models differ in the rows they learn from and in the features they may use. Each has its own medians,
encodings, means and class weights, learned from its own rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from launchlens.operators.encoding import category, category_rows, lookup
from launchlens.plans.selection import exact_quantiles
from launchlens.session import cut_lineage

#: Numbers of target encodings, over all values and models, up to which rows carry a code and tasks get the table.
CODED_NUMBERS = 2_000_000
#: Scores that a task holds before it sends them, and rows for which ranges of scores get twice as fine.
HELD_SCORES, RANGE_ROWS = 4 << 20, 1 << 20


@dataclass(frozen=True)
class Member:
    """One model: learns from rows with another fold than `fold` and a tier up to `tier`, is measured on the rows of `fold`.

    `uses` lists its features by name; None means all.
    """

    fold: int
    tier: int
    uses: tuple[str, ...] | None = None


@dataclass
class Many:
    """Prepared rows and, after `fit`, the coefficients of all models."""

    rows: DataFrame
    members: list[Member]
    numeric: list[str]
    flags: list[tuple[str, str]]
    fill: np.ndarray
    uses: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.empty(0))
    scale: np.ndarray = field(default_factory=lambda: np.empty(0))
    class_weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    steps: int = 0
    #: (model, code, [mean, frequency]) where rows carry codes of encoded values, the last code for values that are not listed.
    encodings: np.ndarray | None = None

    def __getstate__(self) -> dict:
        """What tasks need; a table cannot be sent to them."""
        return {**self.__dict__, "rows": None}

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *[f"{c}={v}" for c, v in self.flags]]


def _in_task(members: Sequence[Member], fold: str = "_fold", tier: str = "_tier") -> Column:
    """Numbers of the models that a row teaches."""
    tests = [F.when((F.col(fold) != m.fold) & (F.col(tier) <= m.tier), F.lit(k)) for k, m in enumerate(members)]
    return F.array_compact(F.array(*tests))


def prepare(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], encoded: Sequence[str], members: Sequence[Member], alpha: float = 10.0, keep: Sequence[str] = ()) -> Many:
    """Rows of `df`, which has _fold and _tier, with what all models need, written once.

    Medians and target encodings of every model come from counts per (value, fold, tier), which are small next to
    the rows; only those are repeated per model. Rows without a label are left out. The values of one-hot
    columns and the medians reach the driver, and up to CODED_NUMBERS target encodings; rows carry codes of those values, and
    beyond that the encodings themselves. `keep` names columns that stay on the rows. `df` is read once.
    """
    needed = dict.fromkeys([*numeric, *categorical, *encoded, *keep, "_fold", "_tier"])
    df = cut_lineage(df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), *[F.col(f"`{c}`") for c in needed]))
    m = len(members)
    made = [f"{c}_{s}" for s in ("te", "fe") for c in encoded]
    each = F.explode(_in_task(members)).alias("_model")
    encodings = None
    fill = np.zeros((m, len(numeric) + len(made)))
    if numeric:
        structs = [F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(numeric)]
        long = df.select("_fold", "_tier", F.inline(F.array(*structs))).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        counts = cut_lineage(long.groupBy("_i", "_v", "_fold", "_tier").agg(F.count("*").alias("_n")))
        per = counts.select("_i", "_v", "_n", each).groupBy("_i", "_model", "_v").agg(F.sum("_n").alias("_n"))
        for row in exact_quantiles(per, ["_i", "_model"], "_v", [0.5], weight="_n").collect():
            fill[row["_model"], row["_i"]] = row["q0"]
    if encoded:
        counts = cut_lineage(category_rows(df, encoded, F.col("_fold"), F.col("_tier"), F.col("_y")).groupBy("column", "value", "_fold", "_tier").agg(F.count("*").alias("n"), F.sum("_y").alias("s")))
        per = counts.select("column", "value", "n", "s", each).groupBy("column", "value", "_model").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        totals = {r["_model"]: (r["n"], r["s"]) for r in per.where(F.col("column") == encoded[0]).groupBy("_model").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
        g = [totals[k][1] / totals[k][0] if k in totals else 0.5 for k in range(m)]
        n = [float(totals[k][0]) if k in totals else 1.0 for k in range(m)]
        at = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("_model"))
        te, fe = (F.col("s") + alpha * at(g)) / (F.col("n") + alpha), F.col("n") / at(n)
        pairs = per.groupBy("column", "value").agg(F.map_from_entries(F.collect_list(F.struct("_model", F.struct(te.alias("te"), fe.alias("fe")).alias("p")))).alias("_by"))
        # a model that has not seen a value gives it the overall mean and 0
        listed = lambda part, rest: F.array(*[F.coalesce(F.col("_by")[F.lit(k)][part], F.lit(rest[k])) for k in range(m)])
        table = cut_lineage(pairs.select("column", "value", listed("te", g).alias("te"), listed("fe", [0.0] * m).alias("fe")))
        n_values = table.count()
        if n_values * 2 * m <= CODED_NUMBERS:
            listed_values = table.orderBy("column", "value").collect()
            encodings = np.array([*([r["te"], r["fe"]] for r in listed_values), [g, [0.0] * m]]).transpose(2, 0, 1)
            codes = [(r["column"], r["value"], i) for i, r in enumerate(listed_values)]
            df = lookup(df, encoded, df.sparkSession.createDataFrame(codes, "column string, value string, code int"), ["code"], n_values)
        else:
            df = lookup(df, encoded, table, ["te", "fe"], n_values * 2 * m)
    flags: list[tuple[str, str]] = []
    if categorical:
        seen = category_rows(df, categorical).groupBy("column", "value").agg(F.count("*").alias("n"))
        flags = sorted((r["column"], r["value"]) for r in seen.collect())
    codes = []
    for c in categorical:
        at = [i for i, (x, _) in enumerate(flags) if x == c]
        place = F.array_position(F.array(*[F.lit(flags[i][1]) for i in at]).cast("array<string>"), category(c))
        codes.append(F.coalesce(F.get(F.array(*[F.lit(i) for i in at]).cast("array<int>"), (place - 1).cast("int")), F.lit(-1)))
    numbers = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in numeric]
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    if encodings is not None:
        e = F.array(*[F.coalesce(F.col(f"`{c}_code`"), F.lit(n_values)) for c in encoded])
    else:
        e = F.concat(*[F.coalesce(F.col(f"`{x}`"), F.lit(g if x.endswith("_te") else [0.0] * m)) for x in made]) if made else empty("double")
    rows = cut_lineage(
        df.select(
            F.col("_fold").cast("int").alias("_fold"),
            F.col("_tier").cast("int").alias("_tier"),
            "_y",
            (F.array(*numbers) if numbers else empty("double")).alias("_x"),
            (F.array(*codes) if codes else empty("int")).alias("_codes"),
            e.alias("_e"),
            *keep,
        )
    )
    out = Many(rows, list(members), [*numeric, *made], flags, fill, np.ones((m, len(numeric) + len(made) + len(flags))), encodings=encodings)
    for k, member in enumerate(members):
        if member.uses is not None:
            out.uses[k] = [name in member.uses or name.rsplit("=", 1)[0] in member.uses for name in out.names]
    return out


#: Columns of the prepared rows, in order.
PREPARED = ("_fold", "_tier", "_y", "_x", "_codes", "_e")


def _feature_rows(many: Many, part) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[int, np.ndarray], np.ndarray]]:
    """(fold, tier, label, features of some rows for a model) of an Arrow batch, features not yet centred."""
    k, m = part.num_rows, len(many.members)
    fold, tier, y = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    flat = [part.column(i).flatten().to_numpy(zero_copy_only=False).reshape(k, -1) for i in (3, 4, 5)]
    coded = many.encodings is not None
    n_encoded = flat[2].shape[1] // m if m and not coded else 0
    encoded = flat[2] if coded else flat[2].reshape(k, n_encoded, m)
    flags = np.zeros((k, len(many.flags) + 1))
    if flat[1].shape[1]:
        flags[np.arange(k)[:, None], flat[1]] = 1.0
    flags = flags[:, :-1]

    def features(model: int, at: np.ndarray) -> np.ndarray:
        if coded:
            pair = many.encodings[model][encoded[at]]
            x = np.concatenate([flat[0][at], pair[:, :, 0], pair[:, :, 1]], axis=1)
        else:
            x = np.concatenate([flat[0][at], encoded[at, :, model]], axis=1)
        x = np.where(np.isnan(x), many.fill[model], x)
        return np.concatenate([x, flags[at]], axis=1)

    return fold, tier, y, features


def _summed(many: Many, width: int, add: Callable[[int, np.ndarray, np.ndarray], np.ndarray], step_rows: int = 8192) -> np.ndarray:
    """(model, number) sums of `add(model, features, labels)` over the rows each model learns from, in one pass."""
    m = len(many.members)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((m, width))
        for batch in batches:
            for at in range(0, batch.num_rows, step_rows):
                fold, tier, y, features = _feature_rows(many, batch.slice(at, step_rows))
                for k, member in enumerate(many.members):
                    mine = np.flatnonzero((fold != member.fold) & (tier <= member.tier))
                    if len(mine):
                        total[k] += add(k, features(k, mine), y[mine])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["model", "line"])

    partial = many.rows.select(*PREPARED).mapInArrow(run, "model int, line array<double>")
    cells = partial.select("model", F.posexplode("line").alias("j", "s")).groupBy("model", "j").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((m, width))
    out[cells.column("model").to_numpy(), cells.column("j").to_numpy()] = cells.column("s").to_numpy()
    return out


def fit(many: Many, penalty: float = 1.0, max_steps: int = 30, tolerance: float = 1e-9) -> Many:
    """Newton steps for all models at once: balanced log loss summed over rows plus half the penalty on squared coefficients.

    A pass adds up loss, gradient and Hessian at the current coefficients of every model. A model whose loss rose
    goes back half of its last step; it is done when a full step would lower the loss by less than
    `tolerance` of it. Numbers are centred and scaled by each model's own rows; the intercept bears no penalty.
    """
    m, p, q = len(many.members), len(many.names), len(many.numeric)
    lines = _summed(many, 2 + 2 * q, lambda k, x, y: np.concatenate([[len(y), y.sum()], (x[:, :q] - many.fill[k]).sum(axis=0), ((x[:, :q] - many.fill[k]) ** 2).sum(axis=0)]))
    n, pos = lines[:, 0], lines[:, 1]
    safe = np.maximum(n, 1.0)[:, None]
    centre = lines[:, 2 : 2 + q] / safe
    spread = np.sqrt(np.maximum(lines[:, 2 + q :] / safe - centre**2, 0.0))
    many.mean, many.scale, many.sizes = many.fill + centre, np.where(spread > 1e-12 * np.maximum(np.abs(many.fill), 1e-300), spread, 1.0), n
    both = np.stack([n - pos, pos], axis=1)
    kinds = np.maximum((both > 0).sum(axis=1), 1)[:, None]
    many.class_weight = np.where(both > 0, n[:, None] / (kinds * np.maximum(both, 1.0)), 0.0)
    many.weights = np.zeros((m, p + 1))
    upper = np.triu_indices(p + 1)
    ridge = np.concatenate([np.full(p, penalty), [0.0]])
    loss = np.full(m, np.inf)
    last = np.zeros((m, p + 1))
    done = n == 0
    for many.steps in range(1, max_steps + 1):
        beta = many.weights.copy()

        def add(k: int, x: np.ndarray, y: np.ndarray, beta: np.ndarray = beta) -> np.ndarray:
            x = _ready(many, k, x)
            z = x @ beta[k]
            prob = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            w = many.class_weight[k][(y > 0.5).astype(int)]
            cost = w * (np.logaddexp(0, z) - y * z)
            hess = (x * (w * prob * (1 - prob))[:, None]).T @ x
            return np.concatenate([[cost.sum()], x.T @ (w * (prob - y)), hess[upper]])

        sums = _summed(many, 2 + p + len(upper[0]), add)
        now = sums[:, 0] + (ridge * beta**2).sum(axis=1) / 2
        for k in np.flatnonzero(~done):
            if now[k] > loss[k] * (1 + 1e-12):
                last[k] /= 2
                many.weights[k] = beta[k] - last[k]
                done[k] = np.abs(last[k]).max() < 1e-12
                continue
            loss[k] = now[k]
            grad = sums[k, 1 : 2 + p] + ridge * beta[k]
            hess = np.zeros((p + 1, p + 1))
            hess[upper] = sums[k, 2 + p :]
            hess = hess + np.triu(hess, 1).T + np.diag(ridge)
            used = np.concatenate([many.uses[k] > 0, [True]])
            step = np.zeros(p + 1)
            step[used] = -np.linalg.lstsq(hess[np.ix_(used, used)], grad[used], rcond=1e-14)[0]
            if -grad @ step / 2 <= tolerance * max(loss[k], 1e-300):
                done[k] = True
                continue
            last[k] = step
            many.weights[k] = beta[k] + step
        if done.all():
            break
    return many


def _ready(many: Many, k: int, x: np.ndarray) -> np.ndarray:
    """Centred and scaled features of a model, with the column of the intercept last."""
    q = len(many.numeric)
    x = np.concatenate([(x[:, :q] - many.mean[k]) / many.scale[k], x[:, q:]], axis=1) * many.uses[k]
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _range_of(p: np.ndarray, bits: int) -> np.ndarray:
    """A whole number that does not fall as probabilities rise: the leading bits of the distance from 0, or from 1 in the upper half."""
    shift = 52 - bits
    half = np.float64(0.5).view(np.int64) >> shift
    lead = np.minimum(p, 1 - p).view(np.int64) >> shift
    return np.where(p < 0.5, lead - half, half - lead)


def _counted(p: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different scores in order, with their positive and negative rows."""
    order = np.argsort(p)
    p, pos, neg = p[order], pos[order], neg[order]
    edge = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return p[edge], np.add.reduceat(pos, edge), np.add.reduceat(neg, edge)


def packed_scores(many: Many, bits: int) -> DataFrame:
    """(model, part, range, p, pos, neg): every model's scored rows to learn from ('train') and to be measured on ('valid').

    A row holds the counted scores of one range from one task, packed, so that a score costs 16 bytes and no row of its own.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[tuple[int, str], list] = {}
        size = 0

        def send() -> Iterator:
            for (k, part), pieces in held.items():
                p, y = (np.concatenate([x[i] for x in pieces]) for i in (0, 1))
                p, pos, neg = _counted(p, y.astype(np.int64), (~y).astype(np.int64))
                of = _range_of(p, bits)
                cut = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(of))
                columns = [[x[lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)] for x in (p, pos.astype("<u4"), neg.astype("<u4"))]
                n = len(cut) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, k, np.int32)), pa.array([part] * n, pa.string()), pa.array(of[cut[:-1]]), *(pa.array(c, pa.binary()) for c in columns)],
                    names=["model", "part", "range", "p", "pos", "neg"],
                )

        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                fold, tier, y, features = _feature_rows(many, batch.slice(at, 8192))
                for k, member in enumerate(many.members):
                    valid = fold == member.fold
                    mine = np.flatnonzero(valid | (tier <= member.tier))
                    if not len(mine):
                        continue
                    z = _ready(many, k, features(k, mine)) @ many.weights[k]
                    p, one, tested = 1 / (1 + np.exp(-np.clip(z, -500, 500))), y[mine] > 0.5, valid[mine]
                    for part, some in (("train", ~tested), ("valid", tested)):
                        if some.any():
                            held.setdefault((k, part), []).append((p[some], one[some]))
                    size += len(mine)
                if size > HELD_SCORES:
                    yield from send()
                    held, size = {}, 0
        yield from send()

    return many.rows.select(*PREPARED).mapInArrow(run, "model int, part string, range long, p binary, pos binary, neg binary")


def keyed_scores(many: Many, keep: Sequence[str], model: int = 0) -> DataFrame:
    """The kept columns of all rows and their probability under one model."""
    rows = many.rows.select(*PREPARED, *keep)
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            _, _, _, features = _feature_rows(many, batch)
            z = _ready(many, model, features(model, np.arange(batch.num_rows))) @ many.weights[model]
            kept = [batch.column(len(PREPARED) + i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*keep, "probability"])

    return rows.mapInArrow(run, f"{types}, probability double")


def group_moments(many: Many, rows: DataFrame, group: str, n_groups: int, model: int = 0) -> np.ndarray:
    """(group, [rows, sums, sums of squares]) of the scaled features of `rows`, which are rows of `many`, in one pass."""
    p = len(many.names)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((n_groups, 1 + 2 * p))
        for batch in batches:
            _, _, _, features = _feature_rows(many, batch)
            x = _ready(many, model, features(model, np.arange(batch.num_rows)))[:, :-1]
            of = batch.column(len(PREPARED)).to_numpy(zero_copy_only=False)
            for g in range(n_groups):
                mine = x[of == g]
                total[g] += np.concatenate([[len(mine)], mine.sum(axis=0), (mine**2).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_groups, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["g", "line"])

    partial = rows.select(*PREPARED, F.col(group).cast("int").alias("_g")).mapInArrow(run, "g int, line array<double>")
    cells = partial.select("g", F.posexplode("line").alias("j", "s")).groupBy("g", "j").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((n_groups, 1 + 2 * p))
    out[cells.column("g").to_numpy(), cells.column("j").to_numpy()] = cells.column("s").to_numpy()
    return out


def aucs(many: Many) -> dict[tuple[int, str], float]:
    """Exact area under the ROC curve by (model, part), one half where a part has one kind of label; one scoring job.

    The share of (positive, negative) pairs in the right order, ties counting one half. Packed scores meet by range and are put in
    order there; negatives of lower ranges are added from one row per range. Ranges get finer as rows get more.
    """
    bits = min(20, 4 + max(0, int(np.ceil(np.log2(max(many.sizes.max(initial=0.0), 1.0) / RANGE_ROWS)))))

    def won(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        p, pos, neg = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("p", "<f8"), ("pos", "<u4"), ("neg", "<u4")))
        _, pos, neg = _counted(p, pos.astype(np.int64), neg.astype(np.int64))
        below = np.cumsum(neg) - neg
        sums = [pos.sum(), neg.sum(), (pos * (below + neg / 2)).sum()]
        return pa.table({**{c: table.column(c)[:1] for c in ("model", "part", "range")}, **{c: pa.array([float(v)]) for c, v in zip(("pos", "neg", "won"), sums, strict=True)}})

    ranges = packed_scores(many, bits).groupBy("model", "part", "range").applyInArrow(won, "model int, part string, range long, pos double, neg double, won double")
    before = Window.partitionBy("model", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    all_won = F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0.0))
    total = ranges.withColumn("won", all_won).groupBy("model", "part").agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))
    found = {(r["model"], r["part"]): r["auc"] for r in total.collect()}
    return {(k, part): found[(k, part)] if found.get((k, part)) is not None else 0.5 for k in range(len(many.members)) for part in ("train", "valid")}
