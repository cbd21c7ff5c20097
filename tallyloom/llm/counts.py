"""Token counts of documents: distinct pre-tokens are encoded once, documents add up counts."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given, mapped, ship_package, text_or_empty, written

#: The split rule of this kind of vocabulary (fixed value; it must equal the library's).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that this process and the library class alike; a test compares them one by one.
SETTLED = "\\x01-\\u0557\\u2000-\\u206f\\u3000-\\u303f\\u4e00-\\u9ff0\\uac00-\\ud7a3"
#: Pre-tokens that the tasks know by heart, (how many, longest): at most 6 MB of short ones and 4 MB of long ones.
FREQUENT = ((1 << 17, 48), (1 << 10, 1 << 12))
SEGMENT = 1 << 16
HELD = 200_000


class Splitter:
    """Pre-tokens of texts as the library's byte-level splitter gives them, a bounded piece of text at a time.

    Texts of settled characters are split by the pattern here, others by the library itself.  Added tokens of the vocabulary
    that stand in a text are cut out first, as the library does, and counted apart.
    """

    def __init__(self, path: str):
        self.library = load(path)
        names = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.pattern = regex.compile(PATTERN)
        self.unsettled = regex.compile(f"[^{SETTLED}]")
        self.border = regex.compile(r"(?<=\w)(?= )")  # a pre-token always ends here

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SEGMENT:
            cut = self.border.search(text, at + SEGMENT)
            if not cut:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:]

    def _plain(self, text: str) -> Iterator[list[str]]:
        for part in self._segments(text) if len(text) > SEGMENT else (text,):
            if self.unsettled.search(part):
                yield [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
            else:
                yield self.pattern.findall(part)

    def __call__(self, text: str) -> tuple[int, Iterator[list[str]]]:
        """How many added tokens stand in the text, and lists of its pre-tokens."""
        if self.added is None or not self.added.search(text):
            return 0, self._plain(text)
        parts = self.added.split(text)
        return len(parts) - 1, (found for p in parts for found in self._plain(p))


def load(path: str):
    """The library's tokenizer, if it is of the kind that this module counts for."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    split, extra = parts["pre_tokenizer"] or {}, parts["added_tokens"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or parts["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in extra):
        raise ValueError(f"{path}: only byte-level vocabularies without normaliser, prefix space or stripping tokens")
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


_SPLITTERS: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


def _occurring(path: str):
    """Pre-tokens with their occurrences, summed within a task as far as ``HELD`` distinct ones go."""

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["piece", "n"])

    def run(batches):
        split, held = splitter(path), Counter()
        for batch in batches:
            for text in batch.column("text"):
                for found in split(text.as_py())[1]:
                    held.update(found)
                    if len(held) > HELD:
                        yield rows(held)
                        held = Counter()
        yield rows(held)

    return run


def _encoded(path: str):
    """How many ids each pre-token has."""

    def run(batches):
        library = splitter(path).library
        for batch in batches:
            texts = batch.column("piece").to_pylist()
            sizes: list[int] = []
            for i in range(0, len(texts), 4096):
                sizes += [len(e) for e in library.encode_batch_fast(texts[i:i + 4096], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array(sizes, pa.int64())], ["piece", "n", "ids"])

    return run


def _looked_up(path: str, frequent):
    """Per document the ids of frequent pre-tokens, and the frequencies of the others."""
    rest = pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())]))

    def run(batches):
        split, known = splitter(path), frequent.value
        for batch in batches:
            totals, others = [], []
            for text in batch.column("text"):
                total, lists = split(text.as_py())
                counts: Counter = Counter()
                for found in lists:
                    counts.update(found)
                rare = []
                for piece, n in counts.items():
                    ids = known.get(piece)
                    if ids is None:
                        rare.append({"piece": piece, "n": n})
                    else:
                        total += n * ids
                totals.append(total)
                others.append(rare)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc"), batch.column("n_bytes"), pa.array(totals, pa.int64()), pa.array(others, rest)],
                ["row", "doc", "n_bytes", "known", "rare"])

    return run


def piece_sizes(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``(piece, n, ids)``: every distinct pre-token of the texts, its occurrences, and its number of ids."""
    ship_package(docs.sparkSession)
    texts = given(docs, text=text_col).filter("text IS NOT NULL")
    each = mapped(texts, _occurring(tokenizer), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return mapped(each, _encoded(tokenizer), "piece string, n long, ids long")


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
                 frequent: tuple = FREQUENT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``; ``over_limit``: more than ``limit`` tokens.

    The distinct pre-tokens of the corpus are found with map-side sums and encoded once each, to a table of piece counts.
    Its most used rows of bounded lengths, as ``frequent`` says, go to all tasks (at most 10 MB of text, whatever the
    corpus); with them each task adds up its documents.  Frequencies of the other pre-tokens, rare by
    choice and so without hot keys, are joined with the table and summed by row.  No ids of a document are ever held.

    Null and empty texts have no bytes and no tokens.  Null ids and repeated rows are counted like others, one row each.
    Further columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sizes = written(piece_sizes(docs, tokenizer, text_col), "piece_sizes")
    heart: dict[str, int] = {}
    for most, chars in frequent:
        top = sizes.filter(F.length("piece") <= chars).orderBy(F.desc("n"), "piece").limit(most)
        heart.update(top.select("piece", "ids").toPandas().itertuples(index=False, name=None))
    known = spark.sparkContext.broadcast(heart)

    base = given(docs, doc=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("row"), F.col("doc").cast("long"), text_or_empty().alias("text"))
    base = base.withColumn("n_bytes", F.octet_length("text").cast("long")).select("row", "doc", "n_bytes", "text")
    kind = "row long, doc long, n_bytes long, known long, rare array<struct<piece:string,n:long>>"
    looked = written(mapped(base, _looked_up(tokenizer, known), kind), "looked_up")
    rare = looked.select("row", F.explode("rare").alias("r")).select("row", F.col("r.piece").alias("piece"), F.col("r.n").alias("times"))
    # every rare piece of a document is in the table, so this inner join loses none
    added = rare.join(sizes.select("piece", "ids"), "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("ids")).alias("more"))
    every = looked.select("row", "doc", "n_bytes", "known").join(added, "row", "left")
    total = F.col("known") + F.coalesce(F.col("more"), F.lit(0))
    return every.select(F.col("doc").alias("doc_id"), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
