import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import lattice_dedup, threshold_topk

SCHEMA = "vec_id long, embedding array<float>, label int, node string, links string"


def _vectors():
    """Clusters, copies, near copies on either side of the bound, and rows that can't link."""
    rng = np.random.default_rng(3)
    rows, vec_id = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.normal(size=16)
            for k in range(rng.integers(1, 7)):
                v = base + rng.normal(size=16) * (0.0 if k % 3 == 0 else 0.25)
                rows.append((vec_id, [float(x) for x in v.astype(np.float32)], label, "x", "y"))
                vec_id += 1
    odd = [None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(vec_id + i, v, 0, None, None) for i, v in enumerate(odd)]
    rows.append((None, rows[0][1], 0, None, None))
    rows.append(rows[0])
    return rows


def _brute(rows, least):
    able = [
        i for i, r in enumerate(rows)
        if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    ]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in able}
    near = {i: [j for j in able if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in able}
    out = []
    for i, r in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in reached:
                    reached.add(j)
                    todo.append(j)
        component = r[0] if r[0] is None else min(rows[j][0] for j in reached)
        out.append((r[0], len(near.get(i, [])), component, r[0] is None or component == r[0]))
    return sorted(out, key=str)


def test_lattice_links_equal_brute_force(spark):
    rows = _vectors()
    for block_rows in (2048, 3):
        got = lattice_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), block_rows=block_rows).collect()
        assert sorted(map(tuple, got), key=str) == _brute(rows, 0.93)


def test_lattice_empty(spark):
    assert lattice_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=8, max_size=8))
def test_decoded_points_are_of_the_lattice_and_the_first_is_nearest(values):
    x = np.array([values])
    points = lattice_dedup.nearest_points(x, 8)[0] / 2
    for p in points:
        whole = np.allclose(p, np.rint(p))
        assert whole or np.allclose(p - 0.5, np.rint(p - 0.5))
        assert (p.sum() if whole else (p - 0.5).sum()) % 2 == 0
    rng = np.random.default_rng(0)
    other = lattice_dedup.nearest_points(x + rng.normal(size=(50, 8)), 1)[:, 0] / 2
    assert ((x[0] - points[0]) ** 2).sum() <= ((x - other) ** 2).sum(1).min() + 1e-9
    assert len({tuple(p) for p in points}) == 8


def test_recall_near_the_bound():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    a, b = lattice_dedup.cells(x), lattice_dedup.cells(y)
    met = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
    assert met.mean() > 0.995


def _brute_top(rows, k, step):
    able = {}
    for vec_id, v, *_ in rows:
        if vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v):
            able.setdefault(vec_id, []).append([math.floor(64 * x) for x in v])
    out = []
    for q in sorted(able):
        if q % step == 0:
            query = able[q][0]
            found = sorted((-sum(a * b for a, b in zip(query, c)), i) for i, cs in able.items() if i != q for c in cs if len(c) == len(query))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return out


def test_top_k_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)], i % 3, None, None) for i in range(400)]
    rows += [(400, [0.0] * 6, 0, None, None), (401, None, 0, None, None), (420, [], 0, None, None), (440, [math.nan] * 6, 0, None, None), (460, [1.0, 2.0], 0, None, None), (None, [1.0] * 6, 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for blocks in ((8192, 512), (64, 7)):
        got = threshold_topk.top_k(df, k=5, candidate_block=blocks[0], query_block=blocks[1])
        assert sorted(map(tuple, got.collect())) == sorted(_brute_top(rows, 5, 20))
    assert threshold_topk.top_k(df.limit(0)).collect() == []


def test_top_k_takes_large_components_exactly(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.25, 3.0]) for _ in range(3)], None, None, None) for i in range(80)]
    rows += [(100, [1e30, 0.5, -1.0], None, None, None), (101, [200000.3, -1e9, 0.0], None, None, None), (120, [-3e5, 1e8 + 0.5, 2.0], None, None, None), (140, [3e38, 0.0, 1e-9], None, None, None)]
    rows = [(i, [float(np.float32(x)) for x in v], *more) for i, v, *more in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    numbers = {i: [64 * int(x) if abs(x) > 2**52 else math.floor(64 * x) for x in v] for i, v, *_ in rows}
    want = []
    for q in (i for i in numbers if i % 20 == 0):
        found = sorted((-held(sum(a * b for a, b in zip(numbers[q], numbers[i]))), i) for i in numbers if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:4])]
    for blocks in ((8192, 512), (32, 3)):
        assert sorted(map(tuple, threshold_topk.top_k(df, k=4, candidate_block=blocks[0], query_block=blocks[1]).collect())) == sorted(want)


def test_top_k_stops_early():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20000, 3))
    x[:, 0] *= 50
    lists = threshold_topk.SortedLists(np.arange(len(x)), np.floor(64 * x))
    query = np.array([64.0, 1.0, -1.0])
    ids, scores = lists.top(query, -1, 3)
    assert list(scores) == sorted((np.floor(64 * x) @ query).astype(int), reverse=True)[:3]
