"""Near-duplicate embeddings over a robust-pruned flat graph.

Vectors of one label are dealt to overlapping shards, each to its two nearest centroids. A shard builds
a graph: for every vector a pool of near and of random members is pruned so that an edge stays only if
no kept neighbour is much closer to its end. The adjacency lists of all shards are united by
vector. Then every shard is searched over the united lists: each vector walks greedily from the
shard's medoid with a beam, and from the members in range that it meets the search expands until no more
are found. Links are checked in double precision. An audit compares a sample of
vectors with all others of their label, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from launchlens.llm.graph import components
from launchlens.session import cut_lineage

#: Distinct vectors of a label that a shard has on average, before overlap, and shards that a vector is dealt to.
SHARD_ROWS, OVERLAP = 500, 2
#: Centroids are fitted on so many vectors at most, the first by a hash, and are at most a sixteenth as many.
SAMPLE_ROWS = 20_000
DEGREE, POOL, RANDOM, ALPHA, BEAM = 24, 40, 12, 1.2, 24
#: Edges this close may lead out of a shard: their ends are searched with it.
HALO = 0.9
#: Vectors that the audit compares with all others.
AUDIT_ROWS = 200
#: Query vectors that one search task takes.
SEARCH_ROWS = 4000


def usable(embedding: Column, label: Column) -> Column:
    """Label and vector not null, components finite and not null, and not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            mine = x[near == j]
            c[j] = mine.sum(axis=0) if len(mine) else x[rng.integers(len(x))]
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def prune(x: np.ndarray, pool: np.ndarray, sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robust pruning of every vector's pool: the nearest is kept and takes out all that are alpha times closer to it than to the vector; repeated.

    `pool` has candidate rows, -1 for none; `sims` their cosines. Distances are those of unit vectors.
    """
    n, width = pool.shape
    far = np.sqrt(np.maximum(2 - 2 * sims, 0))
    alive = pool >= 0
    kept: list[list[int]] = [[] for _ in range(n)]
    rows = np.arange(n)
    for _ in range(degree):
        rows = rows[alive[rows].any(axis=1)]
        if not len(rows):
            break
        pick = np.argmin(np.where(alive[rows], far[rows], np.inf), axis=1)
        chosen = pool[rows, pick]
        for r, c in zip(rows.tolist(), chosen.tolist(), strict=True):
            kept[r].append(c)
        for lo in range(0, len(rows), 256):
            part = rows[lo : lo + 256]
            between = np.einsum("nwd,nd->nw", x[pool[part]], x[chosen[lo : lo + 256]])
            close = alpha * np.sqrt(np.maximum(2 - 2 * between, 0)) <= far[part]
            alive[part] &= ~close
            alive[part, pick[lo : lo + 256]] = False
    return [np.array(k, np.int64) for k in kept]


def build(x: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Adjacency of one shard: pruned pools of near and random members, and the edges back."""
    n = len(x)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    near = min(POOL, n - 1)
    pools, values = [], []
    rng = np.random.default_rng(seed)
    for lo in range(0, n, 512):
        s = x[lo : lo + 512] @ x.T
        mine = np.arange(lo, min(lo + 512, n))
        s[np.arange(len(mine)), mine] = -2
        top = np.argpartition(-s, near - 1, axis=1)[:, :near]
        extra = rng.integers(0, n, (len(mine), RANDOM))
        pool = np.concatenate([top, extra], axis=1)
        own = np.take_along_axis(s, pool, axis=1)
        pool[pool == mine[:, None]] = -1
        pools.append(pool)
        values.append(own)
    out = prune(x, np.concatenate(pools), np.concatenate(values))
    back: list[list[int]] = [[] for _ in range(n)]
    for a, to in enumerate(out):
        for b in to.tolist():
            back[b].append(a)
    lists = [np.unique(np.concatenate([out[a], np.array(back[a], np.int64)])) for a in range(n)]
    width = 2 * DEGREE
    over = [a for a in range(n) if len(lists[a]) > width]
    if over:
        m = max(len(lists[a]) for a in over)
        pool = np.full((len(over), m), -1, np.int64)
        sims = np.full((len(over), m), -2.0)
        for i, a in enumerate(over):
            pool[i, : len(lists[a])] = lists[a]
            sims[i, : len(lists[a])] = x[lists[a]] @ x[a]
        full = prune(x, pool, sims, width)
        for i, a in enumerate(over):
            lists[a] = full[i]
    return lists


def greedy(x: np.ndarray, table: np.ndarray, queries: np.ndarray, start: int, beam: int = BEAM) -> np.ndarray:
    """Beams of the nearest members that a greedy walk from `start` meets, one row a query."""
    m = len(queries)
    ids = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -3.0, x.dtype)
    done = np.ones((m, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = start, queries @ x[start], False
    rows = np.arange(m)
    while len(rows):
        at = np.argmax(np.where(done[rows], -4.0, sims[rows]), axis=1)
        done[rows, at] = True
        near = table[ids[rows, at]]
        new = near >= 0
        s = np.einsum("rkd,rd->rk", x[np.maximum(near, 0)], queries[rows])
        s = np.where(new, s, -3.0)
        both = np.concatenate([ids[rows], np.where(new, near, -1)], axis=1)
        vals = np.concatenate([sims[rows], s.astype(x.dtype)], axis=1)
        past = np.concatenate([done[rows], ~new], axis=1)
        # a member met twice stands twice with one value; the copy already expanded, or else the first, stays
        order = np.lexsort((~past, both), axis=1)
        both, vals, past = (np.take_along_axis(v, order, axis=1) for v in (both, vals, past))
        twice = np.zeros(both.shape, bool)
        twice[:, 1:] = both[:, 1:] == both[:, :-1]
        vals = np.where(twice | (both < 0), -3.0, vals)
        top = np.argpartition(-vals, beam - 1, axis=1)[:, :beam]
        ids[rows], sims[rows] = np.take_along_axis(both, top, axis=1), np.take_along_axis(vals, top, axis=1)
        done[rows] = np.take_along_axis(past, top, axis=1) | (sims[rows] <= -3.0)
        rows = rows[~done[rows].all(axis=1)]
    return np.where(sims > -3.0, ids, -1)


def in_range(x: np.ndarray, table: np.ndarray, query: int, seeds: np.ndarray, least: float, slack: float = 0.02) -> np.ndarray:
    """Members with cosine `least` or more to the query that are reached from `seeds` over members with at least `least - slack`."""
    seen = np.zeros(len(x), bool)
    front = np.unique(np.append(seeds[seeds >= 0], query))
    seen[front] = True
    found = []
    while len(front):
        s = x[front] @ x[query]
        found.append(front[s >= least])
        near = table[front[s >= least - slack]].ravel()
        near = np.unique(near[near >= 0])
        front = near[~seen[near]]
        seen[front] = True
    hits = np.concatenate(found)
    return hits[hits != query]


class Union:
    """Union-find over places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _vectors(column) -> np.ndarray:  # noqa: ANN001
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def near_duplicates(vectors: DataFrame, least: float = 0.98, shard_rows: int = SHARD_ROWS, audit_rows: int = AUDIT_ROWS) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept, audit_links.

    Two vectors link when their labels are equal and not null and their cosine is `least` or more. n_links
    counts the other vectors linked directly, component_id is the smallest vec_id that links reach.
    audit_links is the number of links found by comparing with all vectors of the label, for up to
    `audit_rows` vectors chosen by a hash, else null.

    Vectors that are null, zero, or hold null or non-finite components, and those without a label, link with
    nothing. Vectors of different lengths never link. Equal vectors of a label are one member with a
    weight, so copies of any number cost one row. Rows with a null vec_id link with nothing; rows that
    repeat a vec_id count as vectors of their own and are linked as copies if equal. An empty table gives no rows; other columns are ignored.

    Every row is in the index. What it may miss are links whose ends no walk joins; the audit measures that.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"))
    ok = usable(F.col("x"), F.col("label")) & F.col("vec_id").isNotNull()
    v = v.withColumn("key", F.when(ok, F.xxhash64("label", "x", F.size("x"))))
    reps = v.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min_by(F.struct("label", "x"), "vec_id").alias("r"))
    reps = cut_lineage(reps.select("key", "rep", "weight", F.concat_ws("/", F.size("r.x").cast("string"), "r.label").alias("label"), "r.x"))
    largest = reps.groupBy("label").count().agg(F.max("count"), F.count("*")).first()
    k = -(-(largest[0] or 1) // shard_rows)
    members = _dealt(reps, k)
    members = cut_lineage(members)
    lists = _adjacency(members)
    found = _search(members, lists, least)
    found = cut_lineage(found)
    per = found.groupBy("key").agg(F.sum("links").alias("links"))
    # edges run between keys; a group's id is the smallest vec_id of its members
    groups = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = reps.select("key", "rep", "weight").join(per, "key", "left").join(groups.select(F.col("node").alias("key"), "component"), "key", "left")
    named = cut_lineage(named.withColumn("component", F.coalesce("component", "key")))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    whole = named.join(ids, "component").select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    audit = _audit(reps, least, audit_rows)
    whole = whole.join(audit, "key", "left")
    out = v.select("vec_id", "key").join(whole, "key", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
        "audit_links",
    )


def _dealt(reps: DataFrame, k: int) -> DataFrame:
    """Members by shard: shard, key, weight, x, homes (the shards of the member, the nearest first)."""
    # at most SAMPLE_ROWS vectors, so that what the driver fits is bounded
    lengths = reps.groupBy(F.size("x").alias("n")).count().collect()
    centroids: dict[int, np.ndarray] = {}
    if k > 1:
        rows = reps.orderBy("key").limit(SAMPLE_ROWS).select("x").collect()
        for size in [r["n"] for r in lengths]:
            x = np.array([r["x"] for r in rows if len(r["x"]) == size], float)
            most = min(k, len(x) // 16)
            if most > 1:
                centroids[size] = fit_centroids(unit(x), most)
    shared = reps.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            homes = []
            for x in b.column(4).to_pylist():
                c = shared.value.get(len(x))
                homes.append([0] if c is None else np.argsort(-(c @ unit(np.array([x]))[0]), kind="stable")[:OVERLAP].tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(homes, pa.list_(pa.int32()))], names=["key", "rep", "weight", "label", "x", "homes"])

    dealt = reps.mapInArrow(run, "key long, rep long, weight long, label string, x array<double>, homes array<int>")
    return dealt.withColumn("h", F.explode("homes")).select(F.concat_ws("/", "label", F.col("h").cast("string")).alias("shard"), "key", "weight", "x", "homes", "label")


def _adjacency(members: DataFrame) -> DataFrame:
    """United adjacency lists: key, near (keys), sims."""

    def one(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        table = table.sort_by("key")
        x = unit(_vectors(table.column("x")))
        keys = table.column("key").to_numpy()
        lists = build(x)
        return pa.table(
            {
                "key": pa.array(keys),
                "near": pa.array([keys[a].tolist() for a in lists], pa.list_(pa.int64())),
                "sims": pa.array([(x[a] @ x[i]).tolist() for i, a in enumerate(lists)], pa.list_(pa.float64())),
            }
        )

    parts = members.groupBy("shard").applyInArrow(one, "key long, near array<long>, sims array<double>")
    pairs = F.flatten(F.collect_list(F.arrays_zip("near", "sims")))
    return cut_lineage(parts.groupBy("key").agg(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["near"].alias("near"), F.round(p["sims"], 9).alias("sims")))).alias("e")))


def _search(members: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """(key, links, root) of every member in every shard it is in: links counted there, and a member that its links there lead to.

    A link is counted in the first shard, by name, that has both ends; if no shard has both, in the shard that the
    searching end is nearest to.
    """
    here = members.select("shard", "key")
    own = here.join(lists, "key")
    out = own.select("shard", F.explode("e").alias("e")).where(F.col("e.sims") >= HALO).select("shard", F.col("e.near").alias("key")).distinct()
    halo = out.join(here, ["shard", "key"], "left_anti").join(members.drop("shard", "label").dropDuplicates(["key"]), "key")
    parts = members.groupBy("shard").agg(F.ceil(F.count("*") / SEARCH_ROWS).cast("int").alias("parts"))
    all_members = members.select("shard", "key", "weight", "x", "homes", "label", F.lit(True).alias("mine")).unionByName(
        halo.select("shard", "key", "weight", "x", "homes", F.lit("").alias("label"), F.lit(False).alias("mine"))
    )
    # a large shard is searched in parts, each with all of its members and a share of the queries
    spread = lambda df: df.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = spread(all_members)
    right = spread(own.select("shard", "key", F.col("e.near").alias("near"))).select(F.col("shard").alias("to_shard"), F.col("part").alias("to_part"), F.col("key").alias("from_key"), "near")

    def run(table, adjacency):  # noqa: ANN001, ANN202
        import pyarrow as pa

        table = table.sort_by("key")
        raw = _vectors(table.column("x"))
        x = unit(raw)
        keys, weight = table.column("key").to_numpy(), table.column("weight").to_numpy()
        mine = table.column("mine").to_numpy(zero_copy_only=False).astype(bool)
        homes = table.column("homes").to_pylist()
        shard, part, parts = (table.column(c)[0].as_py() for c in ("shard", "part", "parts"))
        label, number = shard.rsplit("/", 1)
        number = int(number)
        place = {a: i for i, a in enumerate(keys.tolist())}
        n = len(keys)
        near: list[set[int]] = [set() for _ in range(n)]
        for a, to in zip(adjacency.column("from_key").to_pylist(), adjacency.column("near").to_pylist(), strict=True):
            i = place[a]
            for b in to:
                j = place.get(b)
                if j is not None:
                    near[i].add(j)
                    near[j].add(i)
        width = max((len(s) for s in near), default=0) or 1
        table_ = np.full((n, width), -1, np.int64)
        for i, s in enumerate(near):
            table_[i, : len(s)] = sorted(s)
        centre = x[mine].sum(axis=0)
        medoid = int(np.argmax(np.where(mine, x @ centre, -np.inf)))
        queries = np.flatnonzero(mine & (np.arange(n) % parts == part))
        small = x.astype(np.float32)
        links = np.zeros(n, np.int64)
        union = Union(n)
        for lo in range(0, len(queries), 256):
            q = queries[lo : lo + 256]
            for i, beam in zip(q.tolist(), greedy(small, table_, small[q], medoid), strict=True):
                hits = in_range(x, table_, i, beam, least - 1e-9)
                if not len(hits):
                    continue
                dots = raw[hits] @ raw[i]
                exact = dots / (np.sqrt((raw[hits] ** 2).sum(axis=1)) * np.sqrt((raw[i] ** 2).sum()))
                for j in hits[exact >= least].tolist():
                    both = set(homes[i]) & set(homes[j])
                    if number == (min(both, key=str) if both else homes[i][0]):
                        links[i] += weight[j]
                    union.join(i, j)
        roots = [union.find(i) for i in range(n)]
        rows = [i for i in range(n) if links[i] or roots[i] != i]
        return pa.table({"key": pa.array(keys[rows], pa.int64()), "links": pa.array(links[rows], pa.int64()), "root": pa.array(keys[[roots[i] for i in rows]], pa.int64())})

    return left.groupBy("shard", "part").cogroup(right.groupBy("to_shard", "to_part")).applyInArrow(run, "key long, links long, root long")


def _audit(reps: DataFrame, least: float, rows: int) -> DataFrame:
    """key and audit_links for up to `rows` members, by comparing them with every member of their label."""
    chosen = reps.orderBy(F.xxhash64("key"), "key").limit(rows).select("key", "label", "x", "weight").collect()
    shared = reps.sparkSession.sparkContext.broadcast([(r["key"], r["label"], list(r["x"]), r["weight"]) for r in chosen])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[int, int] = {}
        by_label: dict[str, list] = {}
        for key, label, x, weight in shared.value:
            total[key] = 0
            by_label.setdefault(label, []).append((key, x))
        for b in batches:
            labels = np.array(b.column(1).to_pylist(), object)
            keys, weight = b.column(0).to_numpy(), b.column(3).to_numpy()
            for label, asked in by_label.items():
                at = np.flatnonzero(labels == label)
                if not len(at):
                    continue
                x = _vectors(b.column(2).take(pa.array(at)))
                norm = np.sqrt((x * x).sum(axis=1))
                for key, q in asked:
                    q = np.array(q, float)
                    hit = (x @ q / (norm * np.sqrt((q * q).sum())) >= least) & (keys[at] != key)
                    total[key] += int(weight[at][hit].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])

    counted = reps.select("key", "label", "x", "weight").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.join(reps.select("key", "weight"), "key").select("key", (F.col("n") + F.col("weight") - 1).alias("audit_links"))


def audited(result: DataFrame, least: float = 0.9) -> DataFrame:
    """The result, kept in the shared folder, if its audit finds at least `least` of the links; else an error."""
    result = cut_lineage(result)
    if (r := recall(result)) < least:
        raise RuntimeError(f"recall {r:.3f} of the audited vectors' links is below {least}")
    return result


def recall(result: DataFrame) -> float:
    """Share of the audited vectors' links that were found; 1 if they have none."""
    got = result.where("audit_links is not null").agg(F.sum(F.least("n_links", "audit_links")), F.sum("audit_links")).first()
    return 1.0 if not got[1] else got[0] / got[1]


def oracle(least: float = 0.98) -> str:
    """DuckDB SQL of the first four columns over `embeddings`."""
    return f"""
with recursive v as materialized (select vec_id, label, embedding::double[] as x from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(embedding, lambda e: e != 0)) > 0),
l as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id != b.vec_id and len(a.x) = len(b.x)
  and list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= {least}),
r(node, c) as (select distinct a, a from l union select l.b, r.c from r join l on l.a = r.node where r.c < l.b),
g as (select node, min(c) as c from r group by 1),
n as (select a, count(*) as n from l group by 1)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(g.c, e.vec_id) as component_id, e.vec_id = coalesce(g.c, e.vec_id) as kept
from embeddings e left join n on n.a = e.vec_id left join g on g.node = e.vec_id"""
