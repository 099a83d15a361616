import numpy as np
import pytest

from treeline.llm import neargraph
from treeline.llm.neargraph import Settings


def slow(rows, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    least_of = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least_of[find(k)] = min(least_of.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = least_of.get(find(k), i)
        out.append((i, links[k], c, i is not None and i == c))
    return sorted(out, key=str)


def collect(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


def cloud(n, groups, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 24))
    for g in range(groups):
        size = int(rng.integers(2, 25))
        at = rng.choice(n, size, replace=False)
        x[at] = x[at[0]] + 0.15 * rng.normal(size=(size, 24)) * np.linalg.norm(x[at[0]]) / 5
    return [(int(k) * 3, [float(np.float32(v)) for v in row]) for k, row in enumerate(x)]


def test_one_part_agrees_with_brute_force(spark):
    rows = cloud(400, 15)
    assert collect(neargraph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))) == slow(rows)


def test_many_overlapping_shards(spark):
    rows = cloud(900, 30, 1)
    out = neargraph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), Settings(shard=120))
    got, want = collect(out), slow(rows)
    assert sum(min(a[1], b[1]) for a, b in zip(got, want, strict=True)) >= 0.98 * sum(b[1] for b in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))


def linked_cloud(n, seed):
    """Vectors of which many link at cosines just above the limit."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 32))
    for k in range(0, n - 1, 3):
        side = rng.normal(size=32)
        side -= side @ x[k] / (x[k] @ x[k]) * x[k]
        c = rng.uniform(0.951, 0.97)
        x[k + 1] = c * x[k] / np.linalg.norm(x[k]) + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    return [(int(k), [float(np.float32(v)) for v in row]) for k, row in enumerate(x)]


def test_links_near_the_limit_count_on_both_sides(spark):
    rows = linked_cloud(1_500, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {r[0]: r[1] for r in slow(rows)}
    for s in (Settings(shard=200), Settings(shard=200, centroids=8)):  # one level of centroids, and two
        out = neargraph.near_duplicates(df, s).collect()
        got = {r.vec_id: r.n_links for r in out}
        assert sum(got.values()) >= 0.9 * sum(want.values()) and all(got[k] <= want[k] for k in got)
        assert out[0].recall >= s.floor
        for k in range(0, 1_499, 3):  # a lone pair is found by both or by none
            if want[k] == want[k + 1] == 1:
                assert got[k] == got[k + 1]


def test_parts_of_a_large_shard(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=16)
    rows = [(k, [float(np.float32(v)) for v in centre + 0.12 * rng.normal(size=16)]) for k in range(400)]
    rows += [(1_000 + k, [float(v) for v in rng.normal(size=16)]) for k in range(100)]
    out = collect(neargraph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), Settings(shard=60)))
    want = slow(rows)
    assert sum(min(a[1], b[1]) for a, b in zip(out, want, strict=True)) >= 0.97 * sum(b[1] for b in want)
    assert all(a[1] <= b[1] for a, b in zip(out, want, strict=True))


def test_recall_is_measured_where_few_rows_have_links(spark):
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in rng.normal(size=32)]) for k in range(900)]
    alone = neargraph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), Settings(audit=50))
    assert alone.select("recall").distinct().collect()[0].recall is None
    rows.append((5_000, [1.001 * x for x in rows[3][1]]))
    pair = neargraph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), Settings(audit=50))
    assert {r.recall for r in pair.collect()} == {1.0} and pair.where("n_links > 0").count() == 2


def test_too_low_a_recall_is_an_error(spark):
    rows = linked_cloud(300, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    with pytest.raises(neargraph.RecallError):
        neargraph.near_duplicates(df, Settings(floor=1.01, recall=1.01))


def test_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(9, v), (4, v), (4, v), (7, [2.0, 4.0, 6.0]), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (5, [1.0, None, 2.0]), (6, [1.0, float("nan"), 2.0]), (8, [float("inf"), 1.0, 1.0]), (10, [1.0, 2.0]), (None, v), (11, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, embedding array<float>, n_links int, Kept string")
    assert collect(neargraph.near_duplicates(df)) == slow(rows)
    assert neargraph.near_duplicates(df.limit(0)).collect() == []


def test_pruned_lists_are_reached_from_medoids():
    x = neargraph.unit_rows([r[1] for r in cloud(600, 20, 2)])
    graph = neargraph.Graph(x, neargraph.build(x, Settings()))
    found = set()
    for q, node in graph.within(x, np.full(len(x), -1), Settings()):
        found |= set(zip(q.tolist(), node.tolist(), strict=True))
    true = set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.95)), strict=True))
    assert found <= true and len(found) >= 0.9 * len(true)
