"""Surrogates, pieces, packing, archives, shards, licenses, quality: brute force, round trips, held-out accuracy."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import archives, licenses, packing, pieces, quality, sharding, surrogates, vectors

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
KEY = "k'e\\y"


def replaced(df, key=KEY, **kw):
    return {r["doc_id"]: r["text"] for r in surrogates.surrogate_text(df, key, **kw).collect()}


PRIVATE = [
    (1, "Write to jo.li@corp.test or JO.LI@CORP.TEST today."), (2, "jo.li@corp.test again; call +1 (212) 867-5309 or 212-867-5309."),
    (3, "Card 4539 1488 0343 6467, account DE89 3704 0044 0532 0130 00 and GB29NWBK60161331926819."), (4, "Hosts 17.254.3.183 and 17.254.3.184, id 219-09-9999."),
    (5, "password=hunter2hunter2 and token = \"0a1b2c3d4e5f6a7b\"."), (6, "Mr. John Smith met Mrs. Anna Smith and Dr. Smith; г-н Иван Петров wrote."),
    (7, "Nothing here, v1.2 of 2024-01-02 costs 1,000.50."), (8, None), (9, ""), (10, "Card 4539148803436467." + " plain words" * 20_000),
    (1, "Write to jo.li@corp.test or JO.LI@CORP.TEST today."), (None, "jo.li@corp.test"),
]


def test_surrogates_keep_type_format_and_coreference(spark, docs_of, clashing):
    frame = clashing(docs_of(PRIVATE))
    out = surrogates.surrogate_text(frame, KEY, count_col="found")
    assert out.columns == [*frame.columns, "found"] and out.count() == len(PRIVATE)
    rows = out.collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    for r in rows:
        assert r["lang"] in (None, "en") and r["key"] == "clash"
    whole = " ".join(t or "" for t in got.values())
    for secret in ("jo.li", "867-5309", "4539 1488", "4539148803436467", "DE89", "NWBK", "17.254.3", "219-09", "hunter2", "0a1b2c3d", "John", "Smith", "Anna", "Петров"):
        assert secret not in whole, secret
    assert got[7] == PRIVATE[6][1] and got[8] is None and got[9] == ""
    mail, upper = re.findall(r"\S+@\S+", got[1])
    assert upper == mail.upper() and mail in got[2] and got[None] == mail
    plus, bare = re.search(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})\.$", got[2]).groups()
    assert plus != bare
    card = re.search(r"Card (4\d{3} \d{4} \d{4} \d{4}),", got[3])[1]
    digits = [int(c) for c in reversed(card) if c != " "]
    assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    assert card.replace(" ", "") in got[10] and got[10].endswith(" plain words" * 20_000)
    for account in re.findall(r"DE\d\d(?: \w{1,4})+(?= and)|GB\d\d\w+", got[3]):
        a = account.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1
    one, two = re.findall(r"\d+\.\d+\.\d+\.\d+", got[4])
    assert one != two and re.search(r"id 9\d\d-\d\d-\d{4}\.$", got[4])
    assert re.fullmatch(r"password=[a-z]{6}\d[a-z]{6}\d and token = \"[0-9a-f]{16}\"\.", got[5])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+) and Dr\. (\w+); г-н ([А-Я][а-яё]+) ([А-Я][а-яё]+) wrote\.", got[6])
    assert m[2] == m[4] == m[5] and m[1] in surrogates.GIVEN["m-latin"] and m[3] in surrogates.GIVEN["f-latin"] and m[6] in surrogates.GIVEN["m-cyrillic"]
    assert {r["doc_id"]: r["found"] for r in rows}[3] == 3
    assert replaced(frame) == got and replaced(frame, key="other") != got
    assert surrogates.surrogate_text(docs_of([]), KEY).count() == 0


def test_surrogates_stay_distinct_when_draws_clash(spark):
    names = spark.range(300).select(F.lit("given-m-latin").alias("kind"), F.concat(F.lit("name"), F.col("id").cast("string")).alias("canon"))
    taken = spark.createDataFrame([("given-m-latin", n.lower()) for n in surrogates.GIVEN["m-latin"].split()[:10]], "kind string, canon string")
    rows = surrogates.assigned(names.unionByName(taken), KEY).collect()
    made = [r["surrogate"].lower() for r in rows]
    assert len(rows) == 310 == len(set(made)) and not set(made) & {r["canon"] for r in rows}


def test_surrogates_find_room_when_a_form_has_none(spark):
    full = {"phone": [f"+1{k}" for k in range(2000, 10_000)], "secret": [*(f"{c}*******" for c in "abcdefghijklmnopqrstuvwxyz"), "²²²²²²"]}
    rows = surrogates.assigned(spark.createDataFrame([(k, c) for k, v in full.items() for c in v], "kind string, canon string"), KEY).collect()
    made = [(r["kind"], r["surrogate"]) for r in rows]
    assert len(rows) == sum(map(len, full.values())) == len(set(made)) and not {(k, c) for k, v in full.items() for c in v} & set(made)


def test_surrogates_pass_masked_secrets_and_show_longer_numbers(spark, docs_of):
    texts = ["password: ********", "token = ......", "password: 'x*****'", "secret=x***** and +1 23 45"]
    texts += [f"token={c}*****" for c in "abcdefghijklmnopqrstuvwyz"] + [f"+1 {k // 100} {k % 100:02d}" for k in range(2000, 10_000)]
    got = replaced(docs_of([*enumerate(texts)]))
    assert got[0] == texts[0] and got[1] == texts[1]
    assert got[2].split("'")[1] == got[3].split("=")[1].split()[0] != "x*****"
    phones = [got[k] for k in range(29, len(texts))]
    assert len(set(phones)) == 8000 and not set(phones) & set(texts) and all(re.fullmatch(r"\+1 \d\d \d{2,}", p) for p in phones)
    assert got[3].endswith(phones[345])


def test_surrogates_find_secrets_under_any_name(spark, docs_of):
    heads = ["client_secret=", "access_token=", "DB_PASSWORD=", "db_password=", "password_hash=", '{"password": "', "PASSWD=", "api key: ", "Api-Key = '",
             "x-api-key: ", "tokenId: ", "passwordhash=", "'client.secret' : '", "MY_API_KEY_2=", "token_secret=", "password=", 'token = "']
    texts = [f"{h}hunter2{k:02d}' rest" if h.endswith("'") else f'{h}hunter2{k:02d}" rest' if h.endswith('"') else f"{h}hunter2{k:02d} rest" for k, h in enumerate(heads)]
    same = ["Secretary: Johannes", "tokenizer: sentencepiece", "the password is secret", "tokens " * 2000]
    got = replaced(docs_of([*enumerate(texts + same + ["token@corp.test and token-212-867-5309: x", "secret" * 20_000])]))
    for k, h in enumerate(heads):
        assert re.fullmatch(re.escape(h) + r"[a-z]{6}\d{3}" + re.escape(texts[k][len(h) + 9:]), got[k]) and "hunter" not in got[k], h
    assert [got[len(heads) + k] for k in range(len(same))] == same
    assert re.fullmatch(r"[a-z]{5}@\w+\.example\.\w+ and token-\d{3}-\d{3}-\d{4}: x", got[len(texts + same)]) and "867" not in got[len(texts + same)]


def test_what_shares_a_first_hash_stays_apart(spark, docs_of):
    """Word 0 and word 4 of 64 bytes are chosen so that xxhash64 under Spark's seed is the same."""
    texts = [f"{a} {'writes to a house':<23}{b} {'twice a week':<23}" for a, b in (("g@d.corp", "pzYHxOsQ"), ("t@r.corp", "YczdfWxx"))]
    frame = docs_of([*enumerate(texts)])
    assert frame.select(F.xxhash64("text")).distinct().count() == 1
    got = replaced(frame)
    assert got[0].split()[0] != got[1].split()[0] and [got[k].split()[1:] for k in (0, 1)] == [t.split()[1:] for t in texts]
    rows = [(0, [1.0] * 8), (1, [80 / 7, 1.0, 1.0, 1.0, 1.935166481864243e+39, 1.0, 1.0, 1.0])]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.95)
    assert {(r["vec_id"], r["n_links"], r["kept"]) for r in found.collect()} == {(0, 0, True), (1, 0, True)}


def fuzz(seed, n):
    rng = random.Random(seed)
    alphabet = "abcdeéñß漢字 \n\t▁ 😀𐍈.,AA000<the ing tion"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


TEXTS = [*fuzz(6, 800), "a" * 3000, "ab" * 3000, "the" * 2000, " " * 300, "漢" * 300, "x " * 500, "the" + " " * 40 + "end", "\n" * 50, "tion" * 400 + " x"]


def test_pieces_equal_the_library(spark, docs_of, clashing):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [*enumerate(TEXTS), (None, "null id"), (3, TEXTS[3]), (9999, None)]
    frame = clashing(docs_of(rows), "ids")
    encoded = pieces.encode(frame, PIECES)
    texts = dict(rows)
    for r in encoded.collect():
        assert (None if r["ids"] is None else np.frombuffer(r["ids"], "<u4").tolist()) == (None if texts[r["doc_id"]] is None else model.encode(texts[r["doc_id"]]))
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, PIECES).collect()}
    assert back == {i: None if t is None else t.replace("▁", " ") for i, t in rows}
    digest = {r["doc_id"]: r for r in pieces.round_trip(frame, PIECES).collect()}
    assert digest[3]["decoded_sha256"] == hashlib.sha256(TEXTS[3].replace("▁", " ").encode()).hexdigest()
    assert digest[3]["n_ids"] == len(model.encode(TEXTS[3])) and pieces.encode(docs_of([]), PIECES).count() == 0


def test_stream_window_stays_bounded(monkeypatch):
    """Ends kept while a text streams, whatever its length."""
    lattice = pieces.codec(PIECES).lattice
    rng, kept, plain = random.Random(1), [], lattice.last_piece
    monkeypatch.setattr(lattice, "last_piece", lambda window, end, ends, base: (kept.append(len(ends)), plain(window, end, ends, base))[1])
    for text in ("the" * 5000, "ab" * 5000, "".join(rng.choice("etaoinshr") for _ in range(20_000))):
        taken = 0
        for piece in lattice.stream(text):
            assert text.startswith(piece, taken)
            taken += len(piece)
        assert taken == len(text)
    assert max(kept) <= 8 * lattice.longest


@pytest.mark.parametrize("change", [("trainer_spec", "model_type", 1), ("normalizer_spec", "remove_extra_whitespaces", True),
                                    ("normalizer_spec", "precompiled_charsmap", b"x"), ("normalizer_spec", "add_dummy_prefix", False)])
def test_other_kinds_of_models_are_refused(tmp_path, change):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    spec, name, value = change
    setattr(getattr(model, spec), name, value)
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="only models"):
        pieces.check_kind(str(tmp_path / "other.model"))


def check_packing(rows, texts, capacity, end_id=0):
    tokenizer = Tokenizer.from_file(WORDS)
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id] for i, t in texts}
    docs, places = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= capacity
        docs.setdefault(r["doc"], []).append((r["piece"], r["start"], ids))
        places.setdefault(r["sequence"], []).append((r["offset"], r["length"]))
    for i, ids in want.items():
        parts = sorted(docs[i])
        assert [p[0] for p in parts] == list(range(len(parts))) and sum((p[2] for p in parts), []) == ids
        assert all(s == k * capacity for k, s, _ in parts)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(map(len, want.values()))


def test_packing_round_trip_and_tightness(spark, docs_of, clashing):
    rng = random.Random(2)
    texts = [(k, " ".join(rng.choice(["stone", "The", "don't", "x§y", "§", "É", "12,5", "é", " ", "-"]) for _ in range(rng.choice([0, 3, 40, 90, 150, 900])))) for k in range(250)]
    texts += [(1000, None), (1001, ""), (1002, "Stone!\n\n stone\tSTONE  §"), (1003, "word" * 4000), (1004, "q " * 9000)]
    frame = clashing(docs_of(texts))
    got = packing.pieces(packing.sequences(frame, WORDS, capacity=256, open_bins=16)).collect()
    bins, tokens = check_packing(got, texts, 256)
    assert bins <= 1.02 * tokens / 256 + 1
    assert packing.sequences(docs_of([]), WORDS).count() == 0
    twice = packing.pieces(packing.sequences(docs_of([(1, "a b"), (1, "a b"), (None, "c")]), WORDS)).collect()
    assert sorted((r["doc"] or -1, r["length"]) for r in twice) == [(-1, 2), (1, 3), (1, 3)] and len({r["sequence"] for r in twice}) == 1


def test_bins_take_the_best_fit_and_close_the_fullest():
    bins = packing.Bins(10, 2)
    closed = [c for size in (6, 7, 3, 4) for c in bins.add(size, size)]
    assert closed == [[7, 3], [6, 4]]
    bins = packing.Bins(10, 2)
    assert [c for size in (6, 8, 9) for c in bins.add(size, size)] == [[8]] and list(bins.rest()) == [[9], [6]]


PAGES = [(3, "http://a", "x" * 150), (1, "http://b", "x" * 150), (2, None, "x" * 150), (4, "http://c\r\nd", "y" * 99), (5, "é", "y" * 99), (6, "http://e", None),
         (7, "http://f", ""), (8, "http://g", "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 10), (9, "http://h", "z" * 3_000_000), (None, "n", "x" * 150), (1, "http://b", "x" * 150)]


def test_archives_round_trip(spark, clashing, tmp_path):
    frame = clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    got = archives.archived_pages(frame, folder=f"file://{tmp_path}/warc").collect()
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(),
             "revisit" if h == "x" * 150 and i != 1 else "response", 1 if h == "x" * 150 and i != 1 else None) for i, _, h in PAGES]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    for whole in (tmp_path / "warc/whole").iterdir():
        engine = zlib.decompressobj(31)
        engine.decompress(whole.read_bytes())
        assert engine.eof and not engine.unused_data  # one stream for the whole file
    plain = b"".join(sorted(gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc/whole").iterdir()))
    members = 0
    for f in (tmp_path / "warc/members").glob("*.gz"):
        data = f.read_bytes()
        assert gzip.decompress(data) in plain
        lines = (f.parent / f"{f.name}.index").read_text().splitlines()
        at = 0
        for line in lines:
            offset, length, record, kind = line.split("\t")
            assert int(offset) == at and zlib.decompress(data[at:at + int(length)], 31).startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode())
            at += int(length)
        assert at == len(data)
        members += len(lines)
    assert members == len(PAGES)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.archived_pages(empty, folder=f"file://{tmp_path}/none").count() == 0


def test_normaliser_takes_many_members_and_refuses_cut_files(spark, tmp_path):
    record = archives._record("response", "urn:x-page:1", "u", "d", None, b"body")
    (tmp_path / "many.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record * 2))
    one = spark.createDataFrame([(f"file://{tmp_path}/many.warc.gz",)], "archive string")
    new = archives.normalise_archives(one, f"file://{tmp_path}/new")
    assert [r["records"] for r in new.collect()] == [3] and archives.read_archives(new).filter("payload = X'626F6479'").count() == 3
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(record[:-40]))
    with pytest.raises(Exception, match="ends inside a record"):
        archives.normalise_archives(spark.createDataFrame([(f"file://{tmp_path}/cut.warc.gz",)], "archive string"), f"file://{tmp_path}/bad")


def test_shards_fit_and_only_oversized_buckets_split(spark, docs_of, clashing, tmp_path):
    rng = random.Random(8)
    texts = [(k, "é" * rng.randint(0, 60)) for k in range(400)] + [(77, "hot " * 10)] * 300 + [(None, "n"), (5000, None), (5001, ""), (5002, "x" * 5000)]
    frame = clashing(docs_of(texts), "size")
    got = sharding.shards(frame, max_bytes=2000).collect()
    known = lambda i: -1 if i is None else i
    assert sorted((known(r["doc_id"]), r["size"]) for r in got) == sorted((known(i), len((t or "").encode())) for i, t in texts)
    names = {}
    for r in got:
        names.setdefault(r["shard"], []).append(r["size"])
        assert r["depth"] == len(r["shard"])
    for r in got:
        assert r["shard_bytes"] == sum(names[r["shard"]]) and r["shard_rows"] == len(names[r["shard"]])
    assert all(sum(s) <= 2000 or len(s) == 1 for s in names.values())
    for name in names:
        if name:  # the parent of every leaf was too large
            assert sum(sum(s) for n, s in names.items() if n.startswith(name[:-1])) > 2000
        assert not any(o != name and o.startswith(name) for o in names)
    assert sharding.shards(docs_of([])).count() == 0
    sharding.write_shards(frame, f"file://{tmp_path}/out", max_bytes=2000)
    folders = [f for f in (tmp_path / "out").iterdir() if f.is_dir()]
    assert all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == len(texts)


def test_licenses(spark, docs_of, clashing):
    mit, apache = licenses.TEMPLATES["mit-grant"], licenses.TEMPLATES["apache-2.0-header"]
    noise = " ".join(f"word{k}" for k in range(3000))
    swapped = mit.replace("sublicense", "relicense").replace("persons", "people")
    rows = [(1, noise + "\n" + mit.upper() + " " + noise), (2, swapped), (3, apache[: len(apache) // 2]), (4, "Released under the MIT License."), (5, "released -- UNDER the mit license!"),
            (6, noise), (7, None), (8, ""), (9, "one two"), (None, "x Licensed under CC BY-NC 4.0. y"), (4, "Released under the MIT License."), (10, noise * 20 + " " + apache)]
    got = license_rows = licenses.license_matches(clashing(docs_of(rows))).collect()

    def brute(text):
        words = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
        runs = lambda w: [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        own = runs(words(text))
        for name, t in licenses.TEMPLATES.items():
            target = set(runs(words(t)))
            places = [k for k, s in enumerate(own) if s in target]
            common = len(set(own) & target)
            if common >= 0.8 * len(target):
                yield name, common, len(target), min(places), max(places) + 4

    want = sorted(repr((i, *b)) for i, t in rows for b in brute(t))
    assert sorted(repr((r["doc_id"], r["license"], r["matched"], r["shingles"], r["first_word"], r["last_word"])) for r in got) == want
    assert {"mit-grant", "apache-2.0-header", "apache-2.0-notice", "mit-notice", "cc-by-nc-4.0-notice"} <= {r["license"] for r in license_rows}
    assert licenses.license_matches(docs_of([])).count() == 0
    with pytest.raises(ValueError, match="fewer than 5 words"):
        licenses.license_matches(docs_of(rows), templates={"short": "too short"})


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.learn(docs, labels)
    rows = quality.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").filter(quality.held_out()).collect()
    right = sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in rows)
    assert right >= 0.93 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    bad = [r["score"] for r in rows if r["quality"] == 0]
    good = [r["score"] for r in rows if r["quality"] == 1]
    assert np.mean([[g > b for g in good] for b in bad]) > 0.95


def test_quality_scores_equal_plain_compression(spark, docs_of):
    """Each score, worked out anew from the two dictionaries and the weights with the library alone."""
    texts = [(k, f"plain words number {k} " * 30 if k % 2 else "&&& ### $$$ " * (20 + k)) for k in range(60)] + [(90, ""), (91, "mixed &&& words ### é " * 700), (92, None)]
    docs = docs_of(texts)
    model = quality.learn(docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int"))

    def size(data, **settings):
        engine = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, **settings)
        return sum(len(engine.compress(data[i:i + 2048])) for i in range(0, max(1, len(data)), 2048))

    def with_dictionary(data, dictionary):
        return size(data, dict_data=zstandard.ZstdCompressionDict(dictionary), write_dict_id=False)

    for r in quality.score(docs, model).collect():
        data = (dict(texts)[r["doc_id"]] or "").encode()
        good, bad, plain = with_dictionary(data, model.good), with_dictionary(data, model.bad), size(data)
        n = len(data) + 16 * max(1, -(-len(data) // 2048))
        x = np.array([(bad - good) / (bad + good), good / n, (good / n) ** 2, plain / n, (plain / n) ** 2])
        z = ((x - model.mean) / model.scale) @ np.array(model.weights[:-1]) + model.weights[-1]
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_quality_odd_rows_and_the_fold(spark, docs_of, clashing):
    texts = [(k, f"plain words number {k} " * 30 if k % 2 else "&&& ### $$$ " * (20 + k)) for k in range(60)]
    docs = clashing(docs_of([*texts, (100, None), (101, ""), (None, "plain"), (3, texts[3][1]), (102, "plain words " * 100_000)]), "score")
    labels = spark.createDataFrame([(k, k % 2, None) for k, _ in texts] + [(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all((got[k] >= 0.5) == (k % 2 == 1) for k, _ in texts)
    assert got[100] == got[101] and quality.score(docs, model).count() == 65
    assert quality.learn(docs, labels.filter("quality = 1")) is None and quality.score(docs, None).agg(F.min("score")).first()[0] == 0.5
    hidden = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.learn(docs, hidden) == model
    ids = [r[0] for r in labels.filter(quality.held_out()).select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(k for k, _ in [*texts, (1, "")] if zlib.crc32(str(k).encode()) % 3 == 1)
    assert quality.score(docs_of([]), model).count() == 0
