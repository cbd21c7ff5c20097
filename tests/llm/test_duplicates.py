"""MinHash, exact and lattice duplicates against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tallyloom.llm.exact import exact_groups
from tallyloom.llm.graph import components, thinned
from tallyloom.llm.lattice import minimal_vectors, nearest
from tallyloom.llm.minhash import band_count, near_duplicates
from tallyloom.llm.vectors import near_vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def reach(ids, links):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed=3):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 200))] for _ in range(25)]
    texts = [edited(rng, b, k) for b in base for k in (0, 0, 1, 2, 4)]
    texts += [" ".join(base[0]).upper(), "", None, "  \t\n", "one two", "ONE  two", "one two three", "é ü " * 9, "x" * 100_000, "y " * 30_000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("num", [85, 80])
def test_near_duplicates_match_brute_force(spark, docs_of, clashing, num):
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = reach(sets, links)
    got = near_duplicates(clashing(docs_of(rows)), num=num).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_chain_of_near_copies_without_a_centre(spark, docs_of):
    """Neighbours are linked, ends are far apart, and the smallest id is an end: no link may get lost."""
    words = [f"t{i}" for i in range(300)]
    rows = [(k, " ".join(words[4 * k:4 * k + 200])) for k in range(20)]
    got = near_duplicates(docs_of(rows), num=85).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_near_duplicates_odd_rows(spark, docs_of):
    text = "a b c d e f g"
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of([(5, text), (5, text), (None, text), (9, text), (7, "a b")])).collect()}
    assert got == {(5, 5, True), (None, None, True), (9, 5, False), (7, 7, True)}
    assert near_duplicates(docs_of([])).count() == 0


def test_bands_cover_the_threshold():
    assert (1 - 0.85**6) ** band_count(0.85) <= 1e-6 < (1 - 0.85**6) ** (band_count(0.85) - 1)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (None, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_go_on_from_earlier_ones(spark, seed):
    rng = random.Random(seed)
    links = [[(rng.randrange(150), rng.randrange(150)) for _ in range(70)] for _ in range(2)]
    one, two = (spark.createDataFrame(x, "a long, b long") for x in links)
    want = reach(range(150), links[0] + links[1])
    for got in (components(two, components(one)), components(one.unionByName(two))):
        found = {r["node"]: r["component"] for r in got.collect()}
        assert found == {i: want[i] for a, b in links[0] + links[1] for i in (a, b) if a != b}


def test_thinned_edges_keep_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(2000)] + [(5, 5), (None, 1), (99, 98)]
    edges = spark.createDataFrame(pairs, "a long, b long").coalesce(2)
    for most in (1 << 20, 1):
        few = thinned(edges, most)
        assert {r.node: r.component for r in components(few).collect()} == {r.node: r.component for r in components(edges).collect()}
    assert thinned(edges).count() <= 2 * 61 + 3


@pytest.mark.parametrize("every", [True, False])
def test_exact_groups(spark, docs_of, clashing, every):
    long = "z" * 400
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, long + "1"), (7, long + "2"), (8, long + "1"), (9, "A"), (9, "A"), (None, "q"), (12, "a "), (13, "é" * 50_000)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = exact_groups(clashing(docs_of(rows)), all_hashes=every).collect()
    want = sorted((i, max(groups[t or ""], key=lambda x: x or -1), len(groups[t or ""])) for i, t in rows if i is not None)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["doc_id"] is not None) == want
    assert [(r["keep_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got if r["doc_id"] is not None)
    texts = dict(rows)
    for r in got:
        right = hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
        assert r["text_sha256"] == right or (not every and r["text_sha256"] is None and r["group_size"] == 1)
    assert exact_groups(docs_of([])).count() == 0


def test_lattice_points_are_nearest():
    near = minimal_vectors()
    assert len({tuple(v) for v in near}) == 240 and np.allclose((near**2).sum(axis=1), 2)
    x = np.random.default_rng(1).normal(size=(300, 8)) * 3
    p = nearest(x)
    twice = np.rint(2 * p).astype(int)
    assert np.allclose(2 * p, twice) and all(len(set(r % 2)) == 1 for r in twice) and not (p.sum(axis=1) % 2).any()
    own = ((x - p) ** 2).sum(axis=1)
    assert (own <= 1 + 1e-9).all()
    assert all((own <= ((x - p - v) ** 2).sum(axis=1) + 1e-9).all() for v in near)


def vectors(seed=4, size=64):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(60):
        u = rng.normal(size=size)
        u /= np.linalg.norm(u)
        out.append(u)
        for c in (0.955, 0.97, 0.99, 0.94):
            w = rng.normal(size=size)
            w -= (w @ u) * u
            out.append(c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w))
    return np.array(out) * rng.uniform(0.1, 9, size=(len(out), 1))


def test_near_vectors_recall_and_exactness(spark, clashing):
    x = vectors()
    rows = [(k, [float(v) for v in r], k % 3) for k, r in enumerate(x)]
    n = len(rows)
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    rows += [(n + k, v, 0) for k, v in enumerate(odd)] + [(n + 10, rows[0][1], 1), (n + 11, [1.0, 2.0], 1), (n + 12, [2.0, 4.0], 1), (None, rows[0][1], 1)]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = {r["vec_id"]: r for r in near_vectors(frame).collect()}
    u = np.vstack([x, x[:1]])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    ids = list(range(n)) + [n + 10]
    degree = dict(zip(ids, near.sum(axis=1)))
    assert all(got[i]["n_links"] <= degree[i] for i in ids)
    assert sum(got[i]["n_links"] for i in ids) >= 0.98 * sum(degree.values())
    assert all(got[n + k]["n_links"] == 0 and got[n + k]["component_id"] == n + k for k in range(len(odd)))
    assert got[n + 11]["n_links"] == 1 and got[n + 12]["component_id"] == n + 11
    assert got[None]["n_links"] == 0 and got[None]["kept"]
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_large_cell_is_cut_into_blocks(spark, monkeypatch):
    import tallyloom.llm.vectors as module

    monkeypatch.setattr(module, "MEMBERS", 7)
    rng = np.random.default_rng(2)
    u = rng.normal(size=64)
    x = u + 0.02 * rng.normal(size=(40, 64))
    frame = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = near_vectors(frame).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(39, 0)}
