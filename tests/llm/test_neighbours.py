import numpy as np
import pytest

from knowmill.llm import neighbours
from knowmill.llm.neighbours import fit_cells, group_cells, nearest_vectors, similar_pairs
from knowmill.llm.vectorgraph import Graph, prune

SCHEMA = "id string, vector array<float>, cos string, place string"


def vectors(n, groups, seed=0, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    x = centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, 64))
    for i in range(0, n - 3, 10):  # planted near twins
        x[i + 1] = x[i] + 0.15 * rng.normal(size=64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, scale=1.0):
    return spark.createDataFrame([(f"v{i:06}", [float(a) * scale for a in r], "c", "p") for i, r in enumerate(x)], SCHEMA)


def truth(x, k=10):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return s, np.sort(s, axis=1)[:, -k]


def test_graph_recall_and_reachability():
    x = vectors(4000, 60).astype(np.float32)
    g = Graph(x)
    seen, front = set(g.entries.tolist()), g.entries
    while len(front):
        front = np.array([i for i in np.unique(g.edges[front]) if i >= 0 and i not in seen], int)
        seen.update(front.tolist())
    assert len(seen) == len(x)
    near, cos = g.nearest(x, 10, 32, own=np.arange(len(x)))
    s, tenth = truth(x)
    assert np.mean(s[np.arange(len(x))[:, None], near] >= tenth[:, None] - 1e-6) > 0.9
    assert (np.diff(cos, axis=1) <= 0).all() and (near != np.arange(len(x))[:, None]).all()


@pytest.mark.parametrize("n", [1, 2, 3, 17])
def test_tiny_graphs(n):
    x = vectors(40, 3)[:n].astype(np.float32)
    near, _ = Graph(x).nearest(x, 10, 32, own=np.arange(n))
    assert [sorted(i for i in r if i >= 0) for r in near] == [[j for j in range(n) if j != i][:10] if n <= 11 else sorted(i for i in r if i >= 0) for i, r in enumerate(near)]


def test_prune_drops_what_is_nearer_to_a_kept_one():
    x = np.zeros((4, 64), np.float32)
    x[0, 0] = 1
    x[1, :2] = [0.9, 0.43589]
    x[2, :2] = [0.88, 0.47497]
    x[3, [0, 2]] = [0.9, 0.43589]
    ids, _ = prune(x, np.array([[1, 2, 3, -1]]), np.array([[x[0] @ x[1], x[0] @ x[2], x[0] @ x[3], -9]]), 3, 1.2)
    assert sorted(i for i in ids[0] if i >= 0) == [1, 3]


def test_recall_against_brute_force(spark):
    x = vectors(6000, 100)
    rows = frame(spark, x, 3.0)
    s, tenth = truth(x)
    at = {f"v{i:06}": i for i in range(len(x))}
    got = nearest_vectors(rows, shard=500).collect()
    assert len(got) == 10 * len(x)
    assert np.mean([s[at[r["id"]], at[r["other"]]] >= tenth[at[r["id"]]] - 1e-6 for r in got]) >= 0.9
    pairs = {tuple(r) for r in similar_pairs(nearest_vectors(rows, min_cos=0.92, shard=500)).collect()}
    true = {(f"v{min(i, j):06}", f"v{max(i, j):06}") for i, j in zip(*np.nonzero(s >= 0.92))}
    assert not pairs - true and len(true - pairs) <= 0.01 * len(true)
    some = nearest_vectors(rows, probes=None, query_share=50, shard=1500, beam=64).collect()
    assert {len([r for r in some if r["id"] == i]) for i in {r["id"] for r in some}} == {10}
    assert np.mean([s[at[r["id"]], at[r["other"]]] >= tenth[at[r["id"]]] - 1e-6 for r in some]) >= 0.9


def test_unusable_repeated_and_copied(spark):
    x = vectors(60, 3).tolist()
    rows = [(f"a{i:02}", r, "c", "p") for i, r in enumerate(x)]
    rows += [("n1", None, "c", "p"), ("n2", [0.0] * 64, "c", "p"), ("n3", [1.0] * 32, "c", "p"), ("n4", [float("nan")] * 64, "c", "p"), ("n5", [float("inf")] + [0.0] * 63, "c", "p"), ("n6", [], "c", "p"), ("n7", [None] + [1.0] * 63, "c", "p")]
    rows += [rows[0], ("b1", x[5], "c", "p"), ("b2", x[5], "c", "p")]
    got = nearest_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {i: [r["other"] for r in sorted(got, key=lambda r: r["place"]) if r["id"] == i] for i in {r["id"] for r in got}}
    assert set(by) == {f"a{i:02}" for i in range(60)} | {"b1", "b2"} and all(len(set(v)) == 10 == len(v) for v in by.values())
    assert by["a05"][:2] == ["b1", "b2"] and by["b1"][:2] == ["a05", "b2"]
    ids = sorted(by)
    y = np.array([dict((r[0], r[1]) for r in rows)[i] for i in ids])
    s, tenth = truth(y)
    assert all(s[ids.index(i), ids.index(o)] >= tenth[ids.index(i)] - 1e-6 for i, v in by.items() for o in v)


def test_empty_single_and_all_equal(spark):
    assert nearest_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert nearest_vectors(frame(spark, vectors(1, 1))).collect() == []
    got = nearest_vectors(frame(spark, np.repeat(vectors(1, 1), 500, axis=0))).collect()
    assert len(got) == 5000 and {r["other"] for r in got} == {f"v{i:06}" for i in range(11)}
    assert [r["other"] for r in sorted(got, key=lambda r: r["place"]) if r["id"] == "v000003"] == [f"v{i:06}" for i in (0, 1, 2, 4, 5, 6, 7, 8, 9, 10)]


def test_hot_shard_is_split(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = vectors(900, 30)
    x[:400] = x[0] + 0.002 * rng.normal(size=(400, 64))  # nearly equal: no cells can part them
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(neighbours, "PIECE", 1)
    monkeypatch.setattr(neighbours, "CHUNK", 150)
    got = nearest_vectors(frame(spark, x), shard=100).collect()
    s, tenth = truth(x)
    assert len(got) == 9000
    assert np.mean([s[int(r["id"][1:]), int(r["other"][1:])] >= tenth[int(r["id"][1:])] - 1e-5 for r in got]) >= 0.9


def test_cells_are_grouped_evenly():
    x = vectors(3000, 40).astype(np.float32)
    centres, weight = fit_cells(x, 64)
    shard = group_cells(centres, weight, 8)
    held = np.bincount(shard, weights=weight)
    assert weight.sum() == 3000 and held.max() <= 3000 / 8 + weight.max()
