"""Periodic runs against brute force over all periods."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tallyloom.llm import queries
from tallyloom.llm.runs import Dyadic, Wavelet, digests, periodic_runs, runs_of

SMALL = "/root/testdata/sf0.001"


def brute(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def words_of(text):
    out = [""]
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def planted(doc, words):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc, words):
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def sequence(rng):
    """Words with few letters: random, Fibonacci, powers with breaks, powers of powers."""
    n, kind = rng.randrange(160), rng.randrange(5)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    out = []
    while len(out) < n:
        root = [rng.randrange(2) for _ in range(rng.randrange(1, 25 if kind == 2 else 6))]
        out += (root * rng.randrange(1, 30))[:rng.randrange(1, 60)]
        if kind == 4:
            out = (out + [rng.randrange(3)]) * rng.randrange(1, 4)
    return out[:400]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(400):
        words = sequence(rng)
        start, end, period = runs_of(np.array([*words, -1], np.int64))
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == brute(words), words
        least = rng.randrange(12, 40)
        assert [(e - s) for s, e in zip(*(x.tolist() for x in runs_of(np.array([*words, -1]), least)[:2]))] == [r[1] for r in brute(words, least)]


def test_successor_and_extensions_equal_plain_search():
    rng = np.random.default_rng(5)
    values = rng.permutation(300)
    lo, hi, x = (rng.integers(0, 301, 500) for _ in range(3))
    lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
    want = [min((v for v in values[a:b].tolist() if v >= c), default=999) for a, b, c in zip(lo, hi, x)]
    assert Wavelet(values).successor(lo, hi, x, 999).tolist() == want
    seq = np.r_[rng.integers(0, 2, 200), 9]
    index = Dyadic(seq)
    i = rng.integers(0, 199, 300)
    j = i + 1 + rng.integers(0, 199 - i)
    for a, b, f, r in zip(i, j, index.ahead(i, j), index.behind(i, j)):
        assert f == next(k for k in range(201) if seq[a + k] != seq[b + k])
        assert r == next((k for k in range(a) if seq[a - 1 - k] != seq[b - 1 - k]), a)


def corpus():
    rng = random.Random(7)
    texts = [" ".join("ab c"[w] + "x" for w in sequence(rng)) for _ in range(120)]
    texts += ["", None, " \t\r\n\x0b\x0c ", "a " * 12, "a " * 11, "a\x1cb a\x85b " * 6, "é ü\n" * 9, "one two three four five six " * 2, "x" * 90_000,
              "w " * 30_000, " ".join(map(str, range(700))) + " " + " ".join(map(str, range(700)))]
    return list(enumerate(texts)) + [(3, texts[3]), (None, "b " * 20)]


def test_documents_equal_brute_force(spark, docs_of, clashing):
    rows = corpus()
    found = periodic_runs(clashing(docs_of(rows)), plant=True)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted((tuple(r) for r in found.select("doc_id", *digests(found)).collect()), key=repr)
    long = {i for i, t in rows if t and len(t) > 50_000 and " " in t}
    assert [r for r in got if r[0] not in long] == sorted((expected(i, planted(i, words_of(t))) for i, t in rows if i not in long), key=repr)
    assert [(r[1], r[2], r[4]) for r in got if r[0] in long] == [(1, 0, 1)]


def test_registered_runs_equal_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_runs"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc, text in rows:
        if len(text or "") < 6000:
            assert got[doc] == expected(doc, planted(doc, words_of(text)))


def test_no_rows(spark, docs_of):
    assert periodic_runs(docs_of([])).collect() == []
