"""The stages of the corpus pipeline on odd rows and against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallyloom.llm import queries
from .test_duplicates import reach, shingles
from .test_texts import WORDS, check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture
def odd(docs_of, clashing):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t) for k, t in enumerate(base[:4])] + [(200, base[5] + " tail"), (0, base[0]), (5, base[5])]
    rows += [(300, None), (301, ""), (302, None), (None, "a null id writes to jo@x.test"), (303, "mail jo@x.test and " + base[1]), (304, "long " * 50_000)]
    return rows, clashing(docs_of(rows))


def passed(spark, stage, docs):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    return [(r["doc_id"], r["text"]) for r in out.collect()]


def test_exact_stage_keeps_one_row_of_each_text(spark, odd):
    rows, docs = odd
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    got = passed(spark, P.exact_stage, docs)
    assert sorted((t or "", -1 if i is None else i) for i, t in got) == sorted(best.items())


def test_exact_stage_judges_repeated_and_null_ids_by_row(spark, docs_of, clashing):
    rows = [(7, "A"), (7, "B"), (9, "B"), (None, "A"), (None, "C"), (None, "C"), (5, "D"), (5, "D"), (5, "E"), (4, "E"), (None, "E"), (None, None), (3, "")]
    got = passed(spark, P.exact_stage, clashing(docs_of(rows)))
    assert sorted(map(repr, got)) == sorted(map(repr, [(7, "A"), (9, "B"), (None, "C"), (5, "D"), (5, "E"), (3, "")]))


def test_near_stage_keeps_the_smallest_of_each_group(spark, odd):
    rows, docs = odd
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t))
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = reach(ids, links)
    got = {i for i, _ in passed(spark, P.near_stage, docs)}
    assert got == {i for i in ids if root[i] == i} | {None}


def test_privacy_stage_touches_only_texts_with_entities(spark, odd):
    rows, docs = odd
    got = passed(spark, P.privacy_stage, docs)
    assert len(got) == len(rows)
    assert sorted(repr(x) for x in got if "@" not in (x[1] or "")) == sorted(repr(x) for x in rows if "@" not in (x[1] or ""))
    mails = {t.split("@")[0].split()[-1] for _, t in got if t and "@" in t}
    assert len(mails) == 1 and "jo" not in mails
    lengths = P.privacy_stage(spark, docs, SF).filter("text is not null AND length(text) <> n_chars").count()
    assert lengths == 0


def test_quality_stage_passes_what_the_model_accepts(spark, odd):
    _, docs = odd
    got = passed(spark, P.quality_stage, docs)
    again = passed(spark, P.quality_stage, docs)
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) > 0


def test_stages_take_empty_tables(spark, docs_of):
    for name, stage in P.STAGES:
        assert stage(spark, docs_of([]), SF).count() == 0, name


def test_run_keeps_clean_documents_and_packs_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = P.run(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in rows}
    good = [i for i in kept if labels.get(i, 1) == 1]
    assert kept <= set(texts) and len(good) >= 0.97 * len(kept)
    sha = [hashlib.sha256(texts[i].encode()).hexdigest() for i in kept]
    assert len(set(sha)) == len(sha)
    sets = {i: shingles(texts[i]) for i in kept}
    assert not any(a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in kept for b in kept)
    lost = [i for i in set(texts) - kept if labels.get(i) == 1]
    for i in lost:  # copies of kept ones; of the others, few are misjudged
        sets[i] = shingles(texts[i])
    alone = [i for i in lost if not any(sets[i] and 100 * len(sets[i] & sets[k]) >= 80 * len(sets[i] | sets[k]) for k in kept)]
    assert len(alone) <= 0.03 * sum(labels.values())
    masked = {r["doc_id"]: r["text"] for r in P.privacy_stage(spark, docs, SF).collect()}
    plain = [r for r in rows if masked[r["doc_id"]] == texts[r["doc_id"]]]
    assert all(len(np.frombuffer(r["ids"], "<u4")) == r["length"] <= 2048 for r in rows) and plain
    renamed = [{"doc": r["doc_id"], "piece": r["piece"], "start": r["start"], "length": r["length"], "ids": r["ids"], "sequence": r["sequence_id"], "offset": r["offset"]} for r in rows]
    whole = [(i, texts[i]) for i in {r["doc_id"] for r in plain}]
    check = [r for r in renamed if r["doc"] in dict(whole)]
    for r in check:
        r["sequence"], r["offset"] = (r["doc"], r["piece"]), 0
    check_packing(check, whole, 2048)


def test_queries_are_registered_once_each():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries.QUERIES
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "pii_surrogates", "best_fit_packing"]
    assert WORDS and F
