"""The manifest against a tree built whole."""

import random
import zlib
from hashlib import sha256

import pytest

from tallyloom.llm.merkle import manifest

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text=None):
    values = [*row[:4], row[4] if text is None else text]
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([h(rows[-1][i:i + 3]) for i in range(0, len(rows[-1]), 3)])
    return rows


def siblings(rows, at):
    for row in rows[:-1]:
        start = at // 3 * 3
        yield row[start:at], row[at + 1:start + 3]
        at //= 3


def model(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: b"" if s is None else b"g" + s.encode())
    trees = {s: tree([leaf_of(r) for r in groups[s]]) for s in order}
    upper = tree([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for k, row in enumerate(groups[s]):
            path = [*siblings(trees[s], k), *siblings(upper, at)]
            node = leaf_of(row)
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                node = leaf_of(row, row[4].replace("\n", ""))
            for left, right in path:
                node = h([*left, node, *right])
            root = upper[-1][0]
            out.append((row[0], leaf_of(row), trees[s][-1][0], root, h("".join(left + right) for left, right in path), node, node == root))
    return sorted(out, key=repr)


def some(n, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "b\nc", "é", "hot", "hot", "hot", "Z"]
    rows = [(i if rng.random() > 0.02 else None, rng.choice(sources), rng.choice([None, "en", "de"]), rng.choice([None, rng.randrange(99)]),
             rng.choice([None, "", "one\ntwo\n", "plain", "ü\n\r\n", "x" * 5000])) for i in range(n)]
    return rows + rows[:3] + [(n, "alone", "en", 3, "a\nb"), (n + 1, "g", None, None, None)]


@pytest.mark.parametrize("n,height", [(500, 8), (500, 1), (400, 2), (0, 8)])
def test_manifest_equals_a_whole_tree(spark, clashing, n, height):
    rows = some(n, n + height)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest(clashing(docs), height=height).collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == model(rows)
    for r in got:
        assert bool(r.copied) == (not r.verified)
        assert not r.copied or r.copied[-1] == r.folded_root


def test_single_leaf_and_no_rows(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    only = manifest(spark.createDataFrame([(4, None, None, None, None)], kind)).first()
    assert only.leaf == only.subroot == only.root == only.folded_root and only.proof_sha256 == h([]) and only.verified
    assert manifest(spark.createDataFrame([], kind)).collect() == []


def test_only_tampered_versions_fail(spark, docs_of):
    got = {r.doc_id: r.verified for r in manifest(docs_of([(i, "a\nb" if i % 3 else "ab") for i in range(60)])).collect()}
    assert got == {i: not (i % 3 and zlib.crc32(str(i).encode()) % 2 == 0) for i in range(60)}
