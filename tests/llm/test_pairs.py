"""The Jaccard join, near-duplicate vectors and connected components."""

import random
import re

import numpy as np
import pytest

from launchlens.llm import jaccard as J, near_vectors as V
from launchlens.llm.graph import components

SF = "/root/testdata/sf0.001"


def groups_of(nodes, links):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(t, k=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(d for d in sets if sets[d])
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    of = groups_of(sets, links)
    return {(d, len(sets[d]), of[d]) for d in sets}


def varied(seed, n=260):
    """Texts of all sizes around copies with edits, chains of near copies, shared passages, and short ones."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(4000)}"
    passage = [word() for _ in range(60)]
    out, sources = [], [[word() for _ in range(rnd.choice([1, 3, 5, 6, 7, 8, 9, 10, 12, 14, 20, 40, 90, 200]))] for _ in range(30)]
    for d in range(n):
        w = list(rnd.choice(sources))
        for _ in range(rnd.randrange(3)):
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = word()
            else:
                w.insert(rnd.randrange(len(w) + 1), word())
        if rnd.random() < 0.15:
            w += passage
        if rnd.random() < 0.1:
            sources.append(w)
        out.append((d, " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_groups_against_brute_force(spark, monkeypatch, seed):
    if seed == 2:  # long lists, frequent and very frequent shingles on small data
        monkeypatch.setattr(J, "SHORT_LIST", 3)
        monkeypatch.setattr(J, "BOUNDS", (2, 6))
    rows = varied(seed)
    got = J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == brute(rows)


@pytest.mark.parametrize("light", [0, 4, 9, 13])
def test_any_boundary_between_light_and_heavy(spark, monkeypatch, light):
    monkeypatch.setattr(J, "light_bound", lambda sizes, percent: light)
    rows = [r for r in varied(7, 200) if len(r[1].split()) < 26]
    got = J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_needed_overlap_and_subsets():
    for a in range(1, 40):
        for b in range(a, 40):
            c = J.need(a, b)
            assert 100 * c >= 75 * (a + b - c) and 100 * (c - 1) < 75 * (a + b - c + 1)
            assert (b in J.partner_sizes(a)) == (c <= a)
    assert J.subset_sizes(8, 16) == [6, 7, 8] and J.light_bound({}) == 0 and J.light_bound({3: 100, 500: 1}) >= 3


def test_jaccard_on_edge_rows(spark, edge, no_docs):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in J.jaccard_groups(edge).collect())
    assert got.count(("5", 1, 4)) == 2 and ("4", 1, 4) in got and ("None", 4, 6) in got and ("6", 4, 6) in got
    assert ("1", 0, 1) in got and ("2", 0, 2) in got and ("7", 29996, 7) in got and ("8", 29997, 7) in got
    assert J.jaccard_groups(no_docs).collect() == []


def copies(seed, n=60):
    """Words of a text, of a near copy, and of a near copy of that which the first does not link with."""
    rnd = random.Random(seed)
    a = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    b = [*a[: n - 6], *(f"v{rnd.randrange(10**6)}" for _ in range(6))]
    c = [*(f"u{rnd.randrange(10**6)}" for _ in range(6)), *b[6:]]
    return [" ".join(x) for x in (a, b, c)]


def test_jaccard_links_rows_without_doc_id(spark):
    rows = []
    for s in range(12):
        a, b, c = copies(s)
        rows += [(10 * s + 1, a), (None, b), (10 * s + 2, c)]
    a, b, _ = copies(99)
    rows += [(None, a), (None, b), (None, b.upper())]
    a, b, other = copies(100)[0], copies(101)[0], copies(101)[1]
    rows += [(500, a), (500, b), (501, other)]
    got = J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == sorted([*((10 * s + d, 10 * s + 1) for s in range(12) for d in (1, 2)), (500, 500), (500, 500), (501, 500)])
    assert sorted(-1 if r.component_id is None else r.component_id for r in got if r.doc_id is None) == [-1, -1, -1, *(10 * s + 1 for s in range(12))]


def test_one_row_stays_of_each_group(spark):
    rows = []
    for s in range(4):
        a, b, c = copies(s)
        rows += [(10 * s + 1, a, "x"), (None, b, "x"), (10 * s + 2, c, "x"), (None, b, "x")]
    a, b, _ = copies(99)
    rows += [(None, a, "x"), (None, b, "x"), (None, b, "x")]
    a, b, other = copies(100)[0], copies(101)[0], copies(101)[1]
    rows += [(500, a, "x"), (500, b, "x"), (500, b, "x"), (501, other, "x"), (7, " ", "x"), (7, " ", "x"), (None, "", "x"), (None, None, "x")]
    got = J.one_per_group(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id", "text", "lang"]).collect()
    named = sorted((r.doc_id, r.text) for r in got if r.doc_id)
    assert named == sorted([*((10 * s + 1, copies(s)[0]) for s in range(4)), (7, " "), (500, a), (500, b)])
    rest = [r.text for r in got if r.doc_id is None]
    assert len(rest) == 3 and len([t for t in rest if t in copies(99)]) == 1


def test_a_list_of_sets_that_do_not_link_costs_no_row_a_pair(spark, monkeypatch):
    """Copies of one passage with four edits each: every pair shares a long list, none links."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for d in range(120):
        w = list(base)
        for at in rnd.sample(range(2, 20), 1) + rnd.sample(range(27, 45), 1) + rnd.sample(range(52, 70), 1) + rnd.sample(range(77, 95), 1):
            w[at] = f"v{rnd.randrange(10**9)}"
        rows.append((d, " ".join(w)))
    seen, verify = [], J.verify
    monkeypatch.setattr(J, "verify", lambda docs, keys, pairs, *rest: seen.append(pairs.count()) or verify(docs, keys, pairs, *rest))
    got = J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == brute(rows) and sum(seen) < 12 * len(rows)


def test_jaccard_groups_with_lists_in_blocks(spark, monkeypatch):
    for name, value in {"SHORT_LIST": 3, "BOUNDS": (2, 6), "LEADERS": 1, "BLOCK_LIST": 5, "BLOCKS": 3, "CELL_ROWS": 40}.items():
        monkeypatch.setattr(J, name, value)
    rows = varied(5)
    got = J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == brute(rows)


@pytest.mark.parametrize("least", [10**6, 4])
def test_pairs_of_lists_against_all_pairs(spark, monkeypatch, least):
    """Every pair of different groups that shares enough is among the found ones, each once."""
    monkeypatch.setattr(J, "BLOCK_LIST", least)
    monkeypatch.setattr(J, "BLOCKS", 3)
    rng = np.random.default_rng(6)
    sets = [np.unique(np.concatenate([rng.choice(np.arange(60), 50, False), rng.integers(100, 9000, rng.integers(0, 12))])) for _ in range(70)]
    hashed = [np.sort(J.W.mix(s.astype(np.uint64))) for s in sets]
    lists = [(h, k) for h in range(3) for k in range(len(sets)) if h == 0 or rng.random() < 0.4]
    length = {h: sum(x == h for x, _ in lists) for h in range(3)}
    rows = [(h, k, len(sets[k]), k % 9, length[h], bytearray(J.sketch(hashed[k]))) for h, k in lists]
    got = [tuple(r) for r in J.near_in_lists(spark.createDataFrame(rows, "h long, key long, n long, g long, c long, elements binary"), 75, 0).collect()]
    link = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
    want = {(a, b) for a in range(70) for b in range(a + 1, 70) if a % 9 != b % 9 and link(a, b)}
    assert want and want <= set(got) and len(got) == len(set(got)) < 3 * len(want) + 50 and all(a < b and a % 9 != b % 9 for a, b in got)


def test_one_row_per_group_sends_whole_rows_once(spark):
    rows = [(d, copies(d)[0], "x" * 10) for d in range(8)]
    out = J.one_per_group(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id", "text", "lang"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and out.count() == 8


def jobs_of(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(name))


def test_frequent_maps_are_fetched_together(spark):
    docs = spark.createDataFrame([(d, " ".join(f"w{d * 7 + i}" for i in range(60))) for d in range(40)], "doc_id long, text string").cache()
    docs.count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert jobs_of(spark, "maps", lambda: J.frequent_maps(docs, 5, 3)) <= 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_components_stop_at_stars(spark, monkeypatch):
    from launchlens.llm import graph

    kept, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, *a: kept.append(1) or cut(df, *a))
    stars = spark.createDataFrame([(c, c + i) for c in (0, 100) for i in range(1, 30)], "a long, b long")
    assert {tuple(r) for r in graph.components(stars).collect()} == {(c + i, c) for c in (0, 100) for i in range(30)} and len(kept) == 1


def test_small_rows_are_kept_in_few_files(spark):
    from launchlens.llm import graph
    from launchlens.session import cut_lineage

    rows = cut_lineage(spark.range(1000).repartition(300), graph.PARTS_A_FILE)
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and rows.count() == 1000
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written, cut = [], graph.cut_lineage
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(graph, "cut_lineage", lambda df, *a: written.append(cut(df, *a)) or written[-1])
            found = {tuple(r) for r in graph.components(links).collect()}
        assert found == {(i, 0) for i in range(201)} and max(d.rdd.getNumPartitions() for d in written) <= 38
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2000 + i) for i in range(50)]
    df = spark.createDataFrame([*links, (5, None), (None, 6)], "a long, b long")
    nodes = {x for p in links if p[0] != p[1] for x in p}
    want = groups_of(nodes, [p for p in links if p[0] != p[1]])
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).collect() == []


def clustered(seed, n=900):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, 16))
    x = np.concatenate([base, base + rng.normal(scale=0.05, size=base.shape), base[rng.integers(0, 5, n // 3)] + rng.normal(scale=0.04, size=base.shape)])
    return x, rng.integers(0, 2, len(x))


def exact_links(x, label):
    u = V.unit(x)
    s = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(s, False)
    return s


def test_vectors_against_brute_force(spark):
    x, label = clustered(4)
    x = np.concatenate([x, x[:40]])
    label = np.concatenate([label, label[:40]])
    s = exact_links(x, label)
    of = groups_of(range(len(x)), list(zip(*np.nonzero(s))))
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    got = V.near_duplicates(df, shard_rows=80)
    rows = got.collect()
    found, all_links = sum(r.n_links for r in rows), s.sum()
    assert found >= 0.99 * all_links and all(r.n_links <= s[r.vec_id].sum() for r in rows)
    assert np.mean([r.component_id == of[r.vec_id] for r in rows]) > 0.99 and V.recall(got) >= 0.95
    assert all(r.audit_links == s[r.vec_id].sum() for r in rows if r.audit_links is not None)


def test_pruned_graph_is_searchable():
    x = V.unit(clustered(9, 600)[0])
    lists = V.build(x)
    assert max(map(len, lists)) <= 2 * V.DEGREE
    table = np.full((len(x), max(map(len, lists))), -1)
    for i, a in enumerate(lists):
        table[i, : len(a)] = a
    beams = V.greedy(x, table, x, 0)
    assert np.mean([i in b for i, b in enumerate(beams)]) > 0.95


def test_vectors_on_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, 7), (2, [2.0, 0.0], 1, 7), (3, [1.0, 0.0], 2, 7), (4, [1.0, 0.0], None, 7), (5, None, 1, 7), (6, [0.0, 0.0], 1, 7),
        (7, [nan, 1.0], 1, 7), (8, [inf, 1.0], 1, 7), (9, [None, 1.0], 1, 7), (10, [], 1, 7), (11, [1.0], 1, 7), (12, [1.0, 0.0], 1, 7), (12, [1.0, 0.0], 1, 7), (None, [1.0, 0.0], 1, 7),
        (13, [1e200, 1e-200], 1, 7),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key long")
    got = V.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert by[1].n_links >= 3 and by[2].component_id == 1 and by[12].component_id == 1 and not by[12].kept and by[1].kept
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert by[None].n_links == 0 and V.near_duplicates(df.limit(0)).collect() == []
