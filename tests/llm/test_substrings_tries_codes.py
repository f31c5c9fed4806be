import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from linkloom.llm import code_compression, prefix_trie, substring_dedup
from linkloom.scratch import materialise

# ---- substring dedup


def _strip(rows, window):
    """(id, n_words, n_removed, sha, spans) of each row, windows compared as lists of words."""
    words = [(i, (t or "").encode("utf-8").split()) for i, t in rows]
    low = {}
    for i, w in words:
        for p in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[p : p + window])
            low[key] = min(low.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if low[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        spans = sum(1 for p in gone if p - 1 not in gone)
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), spans))
    return sorted(out, key=str)


def _passages(seed, window):
    """Copies, near copies, passages shared by many, runs of one word, odd space, nulls, equal ids and equal rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "Ünï", "d d", "eee"]) + str(rng.randrange(12))
    shared = [[word() for _ in range(rng.choice([window - 1, window, window + 7, 3 * window]))] for _ in range(4)]
    rows = []
    for i in range(40):
        w = [word() for _ in range(rng.randrange(2 * window))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        if rows and rng.random() < 0.4:
            w = (rng.choice(rows)[1] or "").split(" ")
            if rng.random() < 0.5 and w:
                w[rng.randrange(len(w))] = "edited"
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(40, "x " * 4 * window), (41, "x " * 2 * window), (42, None), (43, ""), (44, " \t\n"), (45, rows[3][1]), (45, rows[4][1]), (7, rows[7][1]), (None, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("window", "seed"), [(50, 16), (6, 3), (5, 5)])
def test_repeats_equal_brute_force(spark, window, seed):
    rows = _passages(window, window)
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, mark string, id string, own string")
    found = substring_dedup.remove_repeats(docs, window=window, seed=seed).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest(), len(r.spans)) for r in found), key=str)
    assert got == _strip(rows, window)
    assert all(r.n_removed == sum(s.end - s.first for s in r.spans) for r in found)


def test_repeats_in_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_SLICE", 64)
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = [(1, " ".join(long)), (2, " ".join(["own"] * 30 + long[500:2900] + ["tail"] * 9)), (3, "y" * 300_000 + " " + " ".join(long[10:59]))]
    assert sorted(map(tuple, substring_dedup.kept_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == _strip(rows, 50)


def test_a_hot_passage_and_an_empty_table(spark):
    shared = " ".join(f"s{k}" for k in range(70))
    rows = [(i, f"{i} {shared} end{i}" if i % 3 else shared) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.kept_digests(docs).collect()), key=str) == _strip(rows, 50)
    assert substring_dedup.kept_digests(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs, window=100, seed=10)


# ---- prefix trie


def _trie(rows):
    """The nodes by a walk of a linked trie."""
    own, nodes = defaultdict(list), {}
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    if not turns:
        return []
    members, ends, children, up, last = defaultdict(list), defaultdict(list), defaultdict(set), {}, {0: 0}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        at = 0
        members[0].append(c)
        for x in turns.get(c - c % 100, [])[:h] + mine[h:]:
            to = nodes.setdefault((at, x), len(nodes) + 1)
            children[at].add(to)
            up[to], last[to] = at, len(x[1])
            members[to].append(c)
            at = to
        ends[at].append(c)
    leaves, saved, depth = {}, {}, {0: 0}
    for x in sorted(up):
        depth[x] = depth[up[x]] + 1
    for x in sorted(members, reverse=True):
        leaves[x] = sum(leaves[k] for k in children[x]) or 1
        saved[x] = (len(members[x]) - 1) * last[x] + sum(saved[k] for k in children[x])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(members[x]), depth[x], min(members[up[x]]) if x else None, len(members[x]), len(children[x]), leaves[x], saved[x], sha(ends[x])) for x in members
    )


_CHATS = "conv_id long, turn long, role string, text string, i long, l string, n_turns string"


def _chats(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], _CHATS)


def _odd_chats():
    rows = [(0, 0, "u", "a"), (0, 1, "a", "b"), (0, None, None, None), (1, 0, "u", "a"), (2, 0, "x", "y"), (2, 0, "x", "y"), (None, 1, "u", "z"), (7, 1, "u", "q" * 100_000)]
    rows += [(100, 3, "u", "k"), (105, 1, "u", "k"), (105, 2, "u", "k"), (203, 1, "u", "a"), (204, 0, "u", "a"), (2, 5, "ab", "c"), (3, 5, "a", "bc")]
    rows += [(300 + i, t, "u", "same") for i in range(30) for t in range(6 + i % 3)]
    rows += [(400, t, "u", f"L{t // 50}") for t in range(700)] + [(401, t, "u", f"L{t // 50}") for t in range(900)]
    return rows + [(5000 + i, 1, "u", "s") for i in range(20)]


@pytest.mark.parametrize("cut", [{}, {"segment": 2, "block": 4, "fan_in": 2, "chunk": 3}])
def test_trie_equals_a_walked_trie(spark, cut):
    rows = _odd_chats()
    random.Random(1).shuffle(rows)
    got = prefix_trie.trie_nodes(*prefix_trie.rebuilt_turns(_chats(spark, rows)), **cut).collect()
    assert sorted(map(tuple, got)) == _trie(rows)


def test_a_trie_is_planned_in_small_steps(spark, monkeypatch):
    """The driver holds each step's plan, and again at each of its stages."""
    exchanges = {}

    def noted(df, name):
        exchanges[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
        return materialise(df, name)

    monkeypatch.setattr(prefix_trie, "materialise", noted)
    rows = [(c, t, "user", f"{c % 3} {t}") for c in range(6) for t in range(3)]
    assert sorted(map(tuple, prefix_trie.prefix_trie(_chats(spark, rows)).collect())) == _trie(rows)
    assert exchanges["rows"] <= 20 and max(exchanges.values()) <= 30, exchanges


def test_small_tries(spark):
    for rows in ([], [(250, 1, "u", "t")], [(c, 0, "u", "") for c in range(3)], [(None, 0, "u", "x")]):
        assert sorted(map(tuple, prefix_trie.prefix_trie(_chats(spark, rows)).collect())) == _trie(rows)


def test_nearest_smaller_across_blocks(spark):
    rng = random.Random(5)
    v = [-1] + [rng.choice([0, 1, 2, 3, 9]) for _ in range(60)] + [4] * 30 + list(range(20)) + list(range(20, 0, -1))
    got = {r.i: r for r in prefix_trie.nearest_smaller(spark.createDataFrame(list(enumerate(v)), "i long, v long"), len(v), 5, 3).collect()}
    for i, x in enumerate(v):
        left = max((j for j in range(i) if v[j] < x), default=None)
        right = min((j for j in range(i + 1, len(v)) if v[j] < x), default=None)
        assert (got[i].left, got[i].right) == (left, right)
        assert (got[i].left_v, got[i].right_v) == (None if left is None else v[left], None if right is None else v[right])


# ---- codes


def _lloyd(rows, entries=16, rounds=6):
    """Codes of (id, vector, label) rows by comparing each part with each entry, in Python's integers."""
    able = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    able.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * x) for x in r[1]]))
    whole = [[math.floor(4096 * x) for x in r[1]] for r in able]
    width = len(whole[0]) // 8
    parts = [[w[p * width : (p + 1) * width] for p in range(8)] for w in whole]
    books = [[list(x[p]) for x in parts[:entries]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(8):
            groups = defaultdict(list)
            for x in parts:
                groups[nearest(x[p], p)].append(x[p])
            for e, own in groups.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = [[nearest(x[p], p) for p in range(8)] for x in parts]
    errors = [sum(far(x[p], books[p][c[p]]) for p in range(8)) for x, c in zip(parts, codes, strict=True)]
    total = defaultdict(int)
    for r, e in zip(able, errors, strict=True):
        total[r[2]] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in code), e, total[r[2]], sha) for r, code, e in zip(able, codes, errors, strict=True)), key=str)


_VECTORS = "vec_id long, embedding array<double>, label int, whole string, ids string, code string"


def _codes(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], _VECTORS).repartition(3)
    return sorted(map(tuple, code_compression.compress(df, **more).collect()), key=str)


def test_codes_equal_plain_lloyd(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) if i % 3 else rng.integers(-2, 3, 16) / 4096).tolist(), [0, 1, None][i % 5 % 3]) for i in range(400)]
    rows += [(5, rows[5][1], 1), (1000, rows[9][1], 9), (1001, [0.0] * 16, None), (None, rows[2][1], 0), (1002, [30.0] * 16, 1)]
    odd = [None, [], [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15]
    want = _lloyd(rows)
    assert _codes(spark, rows + [(2000 + k, v, 0) for k, v in enumerate(odd)]) == want
    assert _codes(spark, rows, block_rows=7) == want


def test_codes_of_few_large_and_odd_vectors(spark):
    few = [(i, [float(i // 2)] * 8, 0) for i in range(5)]
    assert _codes(spark, few) == _lloyd(few)
    assert _codes(spark, []) == []
    huge = _codes(spark, [(0, [1e300] * 64, 0), (1, [-1e300] * 64, 0), (2, [1e-300] * 64, 0), (3, [1.0] * 3, 0)], entries=1)
    assert [r[0] for r in huge] == [0, 1, 2] and all(0 <= r[2] <= r[3] for r in huge)
    uneven = _codes(spark, [(i, [0.5, float(i), 1.5], 0) for i in range(20)])
    assert len(uneven) == 20 and all(len(r[1]) == 16 for r in uneven)


def test_filtering_assigns_as_comparing_does():
    rng = np.random.default_rng(8)
    for n in (1, 2, 15, 33, 1000):
        points = rng.integers(-30, 30, (n, 3)).astype(np.int64)
        book = np.concatenate([points[: min(n, 9)], points[:1], rng.integers(-30, 30, (4, 3))])
        tree = code_compression.build_tree(points)
        entry, sums, counts = code_compression.filter_tree(tree, book)
        plain = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert (entry == plain[tree.rows]).all() and (counts == np.bincount(plain, minlength=len(book))).all()
        assert all((sums[e] == points[plain == e].sum(0)).all() for e in range(len(book)))
