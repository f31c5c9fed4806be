import random
import time

import numpy as np
import pytest

from linkloom.llm import chat_format, lattice_dedup, shingle_dedup, url_filter, warc


def _groups(texts, words=5):
    """For each text the smallest place its similar texts lead to, all pairs compared."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        n = min(words, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = a == b if not a or not b else 5 * len(a & b) >= 4 * len(a | b)
            x, y = find(i), find(j)
            if same and x != y:
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("tile", [1 << 17, 300])
def test_similar_texts_are_grouped_as_all_pairs_are(spark, monkeypatch, tile):
    monkeypatch.setattr(shingle_dedup, "TILE", tile)
    rng = random.Random(11)
    texts = [None, "", " ", "one", "One", "one two"]
    for _ in range(3):
        base = [f"w{rng.randrange(4000)}" for _ in range(120)]
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += texts[20:24] + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(20)] + ["v " * 70_000 + "end", "v " * 70_001 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = sorted(r["doc_id"] for r in shingle_dedup.keep_one(docs).collect())
    assert kept == sorted(set(_groups(texts)))


def test_further_links_join_roots_alone(spark, monkeypatch):
    labels = spark.createDataFrame([(n, r) for n, r in ((1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6))], "node long, root long")
    links = spark.createDataFrame([(2, 4), (6, 4), (1, 2)], "a long, b long")
    assert {tuple(r) for r in shingle_dedup._joined(labels, links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 1)}
    monkeypatch.delattr(shingle_dedup, "connected_components")
    assert {tuple(r) for r in shingle_dedup._joined(labels, links.limit(0)).collect()} == {tuple(r) for r in labels.collect()}


def test_common_members_are_counted_exactly(monkeypatch):
    monkeypatch.setattr(shingle_dedup, "_COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(30)]
    left, right = np.arange(18), np.arange(10, 30)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    assert (shingle_dedup.common_counts(sets, left, right) == want).all()
    assert (shingle_dedup.common_counts([np.empty(0, np.uint64)] * 2, np.arange(2), np.arange(2)) == 0).all()


def test_roles_and_texts_of_any_length(spark):
    role = "r]\\ [ <x" * 150_000
    rows = [(1, 0, role, "[/TURN] " * 30_000), (1, 1, "assistant", "] " * 1000), (1, 2, "] ", " [/TURN]"), (2, 0, None, None), (2, 1, "system", " [/SYS]"), (2, 2, "a b", ""), (None, 0, "user", "[INST] x")]
    turns = chat_format.format_turns(spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, place int"))
    got = [(r["conv_id"], r["role"], r["text"]) for r in chat_format.read_turns(turns).orderBy("conv_id", "place").collect()]
    assert got == [(None, "user", "[INST] x")] + [(c, r or "", t or "") for c, _, r, t in sorted(rows[:-1])]
    assert chat_format.read_turns(turns.limit(0)).collect() == []


def test_hosts_of_any_length(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "q" * 3000]
    host = "".join(rng.choice(words[:4]) for _ in range(2000))[:10_000]
    pages = [(i, f"http://{w}{v}.net/a", f"<p>{w} {v}</p>") for i, (w, v) in enumerate(zip(words, words[1:], strict=False))]
    pages += [(90, f"https://{host}.org/fr/x", "alpha " * 50), (91, f"https://{host}{'z' * 2000}.com/", None), (92, f"http://{'q' * 3000}alpha.info/", "")]
    began = time.time()
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert time.time() - began < 60
    assert len(got) == len(pages) and got[90]["host"] == f"{host}.org" and got[90]["words"][:2] == [f"host:{w}" for w in _first(host, words)]
    assert got[92]["words"][:2] == ["host:" + "q" * 3000, "host:alpha"]


def _first(host, words):
    out = []
    while len(out) < 2:
        out.append(next(w for w in words if host.startswith(w)))
        host = host[len(out[-1]) :]
    return out


def _plain_split(model, run):
    """Viterbi over all pieces of a run."""
    best, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        score, at = max((best[at] + model.log_p.get(run[at:end], model._unknown(end - at)), -at) for at in range(end))
        best.append(score)
        back.append(-at)
    words, end = [], len(run)
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def test_splits_equal_a_try_of_all_pieces():
    rng = random.Random(8)
    for _ in range(60):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))): rng.randrange(1, 50) for _ in range(rng.randrange(1, 12))}
        model = url_filter.Segmenter(vocabulary, sum(vocabulary.values()) * 3)
        for _ in range(10):
            run = "".join(rng.choice("abcd") for _ in range(rng.randrange(25)))
            assert model.split(run) == _plain_split(model, run)


def test_very_small_and_large_vectors_link_by_their_direction(spark):
    rows = [(1, [1e-200, 1e-202], 0), (2, [1.0, 0.01], 0), (3, [1e200, 1e198], 0), (4, [0.01, 1.0], 0), (5, [1e300, -1e300], 0), (6, [5e-324, 0.0], 0), (7, [0.0, 0.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 6: (3, 1), 4: (0, 4), 5: (0, 5), 7: (0, 7)}


def test_archives_of_long_pages_and_null_ids(spark):
    long = "x" * 3_000_000
    rows = [(1, "http://a/", long), (2, None, long), (3, "http://c/", None), (None, "http://d/", long), (4, "http://e/", "y" * 99), (5, "http://f/", "y" * 99)]
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (3_000_000, "response", None), 2: (3_000_000, "revisit", 1), 3: (0, "response", None), None: (3_000_000, "response", None), 4: (99, "response", None), 5: (99, "response", None)}
