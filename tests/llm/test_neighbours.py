import numpy as np
import pyarrow as pa

from tidemark.llm import neighbours
from tidemark.llm.neighbours import build_graph, encode, encode_vectors, exact_cosine, greedy_search, nearest_ids, node_rows

DIMS = 32


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == DIMS and None not in v and np.isfinite(np.array(v, float)).all() and any(v):
            ok[i] = np.array(v, np.float64)
    ids = sorted(ok)
    x = np.stack([ok[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    return {i: [j for _, j in sorted((-s[a, b], j) for b, j in enumerate(ids) if b != a)[:k]] for a, i in enumerate(ids)}


def found(spark, rows, k=5, **kw):
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, hash string, sim double")
    graph = build_graph(df, "vec_id", "embedding", DIMS, k, **kw)
    got = {}
    for r in nearest_ids(graph, k).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["other"]
    return {i: [p[n] for n in sorted(p)] for i, p in got.items()}


def vectors(n, clusters, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, DIMS))
    x = np.rint((centres[rng.integers(clusters, size=n)] + 0.4 * rng.standard_normal((n, DIMS))) * 30)
    return [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]


def test_one_cell_is_exact_with_copies_scales_and_bad_rows(spark):
    rows = vectors(60, 6)
    rows += [(100 + i, rows[0][1]) for i in range(9)] + [(200, [2 * v for v in rows[1][1]])]
    rows += [(300, None), (301, [1.0]), (302, [0.0] * DIMS), (303, [float("nan")] + [1.0] * (DIMS - 1)), (304, [None] + [1.0] * (DIMS - 1)), (None, rows[2][1]), (5, rows[5][1])]
    assert found(spark, rows) == brute(rows, 5)


def test_many_cells_reach_the_recall(spark):
    rows = vectors(1500, 60)
    want, got = brute(rows, 5), found(spark, rows, cell=128)
    assert sum(len(set(want[i]) & set(got[i])) for i in want) >= 0.97 * 5 * len(want)


def test_small_and_empty_tables(spark):
    rows = vectors(3, 1)
    assert found(spark, rows[:0]) == {} and found(spark, rows[:1]) == {} and found(spark, rows) == brute(rows, 5)


def test_codes():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4, DIMS)).astype(np.float32)
    x[0] = np.rint(x[0] * 20) / 512
    x[1] = x[0] * 1.7
    codes, _ = encode(x)
    assert len(codes[0]) == DIMS and codes[0] == codes[1] and len(codes[2]) == 2 * DIMS
    true = float(x[2].astype(float) @ x[3].astype(float) / np.linalg.norm(x[2]) / np.linalg.norm(x[3]))
    assert abs(exact_cosine([codes[2]], [codes[3]], DIMS)[0] - true) < 1e-4


def test_greedy_search(spark):
    rows = vectors(800, 40)
    graph = build_graph(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), "vec_id", "embedding", DIMS, cell=128)
    queries = graph.codes().where("id % 10 = 0").join(graph.light.withColumnRenamed("node", "id").select("id", "cells", "sketch"), "id").selectExpr("id as q", "code", "sketch", "cells")
    got = {}
    for r in greedy_search(graph, queries, 6).collect():
        got.setdefault(r["q"], set()).add(r["node"])
    want = brute(rows, 5)
    assert sum(len(set(want[q]) & got[q]) for q in got) >= 0.9 * 5 * len(got) and len(got) == 80
    assert greedy_search(graph, queries.limit(0)).count() == 0


def test_copies_are_dropped_before_the_cells(spark):
    rows = vectors(40, 4)
    hot = rows + [(1000 + i, rows[0][1]) for i in range(300)] + [rows[7]] * 50
    df = spark.createDataFrame([(i, v) for i, v in hot], "vec_id bigint, embedding array<float>")
    graph = build_graph(df, "vec_id", "embedding", DIMS)
    assert graph.members.count() == 390
    for limit in (0, 1000):
        kept = node_rows(encode_vectors(df, "vec_id", "embedding", DIMS), graph.light, 40, limit).distinct()
        assert sorted(r["id"] for r in kept.collect()) == list(range(40))


def test_joins_raise_the_recall_from_a_random_graph(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 1536))
    x = centres[rng.integers(20, size=600)] + 0.5 * rng.standard_normal((600, 1536))  # on no grid of integers
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    want = np.argsort(-sims, axis=1)[:, :5]
    recall = []
    for kw in ({"rounds": 0, "check": False}, {"check": False}, {}):
        graph = build_graph(df, "vec_id", "embedding", 1536, **kw)
        lists = {r["a"]: r["b"][:5] for r in graph.near.collect()}
        recall.append(np.mean([len(set(want[i]) & set(lists.get(i, []))) / 5 for i in range(600)]))
    assert recall[0] < 0.2 and recall[1] >= 0.95 and recall[2] >= 0.99


def settled(x, k=5, ids=None, **kw):
    """The lists of one cell, made in one pass over its codes."""
    codes, sketches = encode(x.astype(np.float32))
    n = len(x)
    nodes = pa.table({"cell": [0] * n, "id": np.arange(n) if ids is None else ids, "code": codes, "sketch": [s.tobytes() for s in sketches], "home": [0] * n})
    out = neighbours._settle_cell(x.shape[1], k, 12, 0.002, kw.get("rounds"), kw.get("check", True))(nodes)
    return {a: b[:k] for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())}


def test_a_cell_settles_in_one_pass(monkeypatch):
    rows = vectors(700, 30)
    want = brute(rows, 5)
    whole = np.array([v for _, v in rows])
    rng = np.random.default_rng(1)
    broken = whole + 0.3 * rng.standard_normal(whole.shape)  # on no grid of integers
    for x in (whole, broken):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        sims = unit @ unit.T
        joined, checked = settled(x, check=False), settled(x)
        if x is whole:
            assert checked == want
        assert np.mean([sims[i, j] >= np.sort(np.delete(sims[i], i))[-5] - 1e-4 for i, near in checked.items() for j in near]) == 1
        same = lambda other: np.mean([len(set(other[i]) & set(checked[i])) / 5 for i in checked])
        assert same(settled(x, rounds=0, check=False)) < 0.2 and same(joined) >= 0.95
        with monkeypatch.context() as m:  # a cell too large for its table
            m.setattr(neighbours, "TABLE", 0)
            assert settled(x) == checked
    assert settled(whole[:1]) == {} and settled(whole[:3]) == brute(rows[:3], 5)
    twice = np.concatenate([np.arange(700), np.arange(5)])  # rows delivered twice
    assert settled(np.concatenate([whole, whole[:5]]), ids=twice) == want


def test_ties_in_a_cell_go_to_the_smaller_ids():
    x = np.ones((40, DIMS))
    x[np.arange(1, 33), np.arange(32)] = 2  # all of them as far from each other and from the first
    x = x[:33]
    near = settled(x)
    assert near[0] == [1, 2, 3, 4, 5] and near[9] == [0, 1, 2, 3, 4] and near == brute([(i, list(v)) for i, v in enumerate(x)], 5)


def test_vectors_are_read_and_encoded_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(vectors(600, 20), "vec_id bigint, embedding array<float>").mapInArrow(count, "vec_id bigint, embedding array<float>")
    assert nearest_ids(build_graph(df, "vec_id", "embedding", DIMS, cell=128), 5).count() == 3000
    assert read.value == 600


def test_more_nodes_than_are_lent_find_their_cells_without_a_join(spark):
    rows = vectors(600, 5)
    rows += [(1000 + i, rows[3][1]) for i in range(20)] + [rows[7]] * 3  # copies, and a row delivered again
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    many, one = (build_graph(df, "vec_id", "embedding", DIMS, cell=c, broadcast_limit=5) for c in (64, 1024))
    assert many.rounds and not one.rounds and sorted(r["a"] for r in many.near.select("a").collect()) == list(range(600))
    want = brute(rows, 5)
    for graph, least in ((many, 0.9), (one, 1)):
        got = {}
        for r in nearest_ids(graph, 5).collect():
            got.setdefault(r["id"], {})[r["place"]] = r["other"]
        assert sum(len(set(want[i]) & set(got[i].values())) for i in want) >= least * 5 * len(want)
