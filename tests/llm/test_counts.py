"""Token counts against the library's own encoder."""

import os

import pytest
import regex

from tallyloom.llm import counts, queries

SMALL = "/root/testdata/sf0.001"
PATH = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


ODD = [
    "", None, " ", "\n\n x", "  two  blanks ", "it's we'll 'S 's", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext", " <|endoftext|> ",
    "tab\tnew\r\nline  nbsp em　wide", "x\x00y\x1cz\x85w", "naïve café ½ ² Ⅷ", "日本語テキスト 한국어", "अनुच्छेद ไทย עברית", "😀👩‍👩‍👧 \U000107bb \U0001e900",
    "՘֋࢏꟎", "x" * 70_000, "-" * 100 + " " + "-" * 100, "word " * 40_000, "é " * 40_000 + "<|endoftext|>", "1234567890" * 9_000, "​﻿",
]


def test_counts_equal_the_library(spark, docs_of, clashing, library):
    rows = list(enumerate(ODD)) + [(5, ODD[5]), (None, "no id"), (-3, "repeated"), (-3, "repeated")]
    want = sorted(((-99 if i is None else i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows))
    docs = clashing(docs_of(rows))
    for frequent in (counts.FREQUENT, ((3, 48), (1, 4096)), ()):
        out = counts.token_counts(docs, PATH, frequent=frequent)
        assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        got = [(-99 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in out.collect()]
        assert sorted(got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in out.collect())


def test_registered_counts_equal_the_library(spark, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.QUERIES["op11_tokens"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        assert got[r.doc_id] == (len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False)))


def test_each_piece_is_encoded_once(spark, docs_of):
    found = counts.piece_sizes(docs_of([(1, "the cat the cat"), (2, "the cat"), (3, None)]), PATH).collect()
    assert sorted((r.piece, r.n) for r in found) == [(" cat", 3), (" the", 1), ("the", 2)]


def test_no_rows(spark, docs_of):
    assert counts.token_counts(docs_of([]), PATH).collect() == []


def test_settled_characters_split_as_in_the_library(library):
    split, pattern = library.pre_tokenizer.pre_tokenize_str, regex.compile(counts.PATTERN)
    for c in regex.findall(f"[{counts.SETTLED}]", "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000)]))):
        text = f"a{c}1{c} {c}!"
        assert [b for _, b in split(text)] == [m.span() for m in pattern.finditer(text)], hex(ord(c))


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        counts.load(queries.tokenizer_path("word_bpe_49k.json"))
