"""Bounded-space online best-fit packing of token ids into sequences."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given, mapped, text_or_empty, written

CAPACITY = 2048
OPEN_BINS = 512
LEFT_OVER = 8192
SEQUENCES = "docs array<long>, pieces array<int>, starts array<long>, lengths array<long>, ids binary, filled int, open boolean, sequence long"
PIECES = "doc long, piece int, start long, length long, ids binary"


class Bins:
    """Open bins in a bitset keyed by free space: bit f is set when some open bin has f places left.

    An item goes to the open bin that it fills best.  If none has room, a new bin is opened; when
    ``most`` are open already, the fullest is closed first.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open = capacity, most, 0
        self.free_bits, self.by_free = 0, {}

    def _take(self, free: int) -> list:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.free_bits ^= 1 << free
        return found

    def add(self, size: int, item) -> Iterator[list]:
        fitting = self.free_bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            items = self._take(free)
        else:
            if self.open == self.most:
                self.open -= 1
                yield self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, items = self.capacity, []
            self.open += 1
        items.append(item)
        free -= size
        if free:
            self.by_free.setdefault(free, []).append(items)
            self.free_bits |= 1 << free
        else:
            self.open -= 1
            yield items

    def rest(self) -> Iterator[list]:
        for free in sorted(self.by_free):
            yield from self.by_free[free]


class Encoder:
    """Token ids of texts, through a bounded memory of blank-separated chunks.

    The vocabulary's pre-tokeniser drops white space and never joins across it, so a text's ids are
    those of its chunks in turn; marks after a letter are a piece of their own too.  Unknown chunks are
    encoded many at once: one that is all letters ends at the first token that closes a word, and ASCII
    letters need nothing of the normaliser but lower case.
    """

    CHARS = 1 << 20
    MARKS = ".,;:!?%$&*#+=@~^|/()[]{}<>-\""

    def __init__(self, path: str, limit: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.tokens = Tokenizer.from_str(json.dumps(parts))
        parts |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.lower = Tokenizer.from_str(json.dumps(parts))
        for t in (self.tokens, self.lower):
            t.no_truncation()
            t.no_padding()
        size = self.tokens.get_vocab_size()
        self.closes = np.array([(self.tokens.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.limit, self.known, self.older = limit, {"": b""}, {}
        self.marks: dict[str, bytes] = {}

    def _plain(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokens.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str], ascii_only: bool) -> list[bytes]:
        """Chunks of letters, encoded as one text and cut where words close."""
        text = " ".join(words)
        found = self.lower.encode_batch_fast([text.lower()], add_special_tokens=False) if ascii_only else self.tokens.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(found[0].ids, "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):  # a letter that falls apart when its case is dropped
            return self._plain(words)
        ends = (4 * ends).tolist()
        data = ids.tobytes()
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def _ending(self, marks: str) -> bytes:
        """Ids of marks that stand behind letters."""
        ids = self.marks.get(marks)
        if ids is None:
            if len(self.marks) > 50_000:
                self.marks.clear()
            ids = self.marks[marks] = self._plain([marks])[0]
        return ids

    def _recall(self, chunks: set[str]) -> set[str]:
        """Bring back what the older half of the memory holds; the others are returned."""
        older = self.older
        if not older:
            return chunks
        self.known.update([(c, older[c]) for c in chunks if c in older])
        return chunks.difference(older)

    def _learn(self, new: set[str]) -> None:
        known, ending, all_marks = self.known, self._ending, self.MARKS
        plain, lower, others, marked = [], [], [], []
        new = self._recall(new)
        for c in new:
            if c.isalpha():
                (lower if c.isascii() else plain).append(c)
                continue
            stem = c.rstrip(all_marks)
            if stem.isalpha():
                marked.append((c, stem))
            else:
                others.append(c)
        for c in self._recall({stem for _, stem in marked if stem not in known}.difference(new)):
            (lower if c.isascii() else plain).append(c)
        known.update(zip(others, self._plain(others)))
        for words, ascii_only in ((lower, True), (plain, False)):
            for i in range(0, len(words), 5_000):
                known.update(zip(words[i:i + 5_000], self._words(words[i:i + 5_000], ascii_only)))
        known.update([(c, known[stem] + ending(c[len(stem):])) for c, stem in marked])

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.CHARS:
            end = text.rfind(" ", at, at + self.CHARS)
            if end < 0:
                end = text.find(" ", at + self.CHARS)
            if end < 0:
                break
            yield text[at:end]
            at = end + 1
        yield text[at:]

    def _some(self, texts: list[str]) -> list[bytes]:
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > self.limit:
            self.known, self.older = {"": b""}, self.known
        self._learn(set().union(*chunks).difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in chunks]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        group, chars = [], 0
        for text in texts:
            if len(text) > self.CHARS:
                yield from self._some(group)
                group, chars = [], 0
                yield b"".join(self._some([s])[0] for s in self._segments(text))
                continue
            group.append(text)
            chars += len(text)
            if chars > self.CHARS:
                yield from self._some(group)
                group, chars = [], 0
        yield from self._some(group)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, remember: int) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].limit = remember
    return _ENCODERS[path]


def _packed(items: Iterator[tuple], capacity: int, most: int, first: int, hold: bool) -> Iterator[pa.RecordBatch]:
    """Sequences as they close.  ``items``: (doc, piece, start, ids).  ``hold``: bins left at the end are marked open."""
    bins, rows, number = Bins(capacity, most), [], first

    def batch():
        cols = [[[x[k] for x in r] for r, _ in rows] for k in (0, 1, 2)]
        lengths = [[len(x[3]) // 4 for x in r] for r, _ in rows]
        out = pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.list_(pa.int64())), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.list_(pa.int64())),
             pa.array(lengths, pa.list_(pa.int64())), pa.array([b"".join(x[3] for x in r) for r, _ in rows], pa.binary()),
             pa.array([sum(n) for n in lengths], pa.int32()), pa.array([o for _, o in rows], pa.bool_()),
             pa.array(range(number, number + len(rows)), pa.int64())],
            ["docs", "pieces", "starts", "lengths", "ids", "filled", "open", "sequence"])
        return out

    def flow():
        for item in items:
            for done in bins.add(len(item[3]) // 4, item):
                yield done, False
        for left in bins.rest():
            yield left, hold

    for row in flow():
        rows.append(row)
        if len(rows) == 256:
            yield batch()
            number += len(rows)
            rows = []
    if rows:
        yield batch()


def _texts_to_sequences(path: str, capacity: int, most: int, end_id: int, remember: int):
    tail = int(end_id).to_bytes(4, "little")

    def items(batches):
        enc = encoder(path, remember)
        for batch in batches:
            docs = batch.column("doc").to_pylist()
            texts = (t for t in batch.column("text").to_pylist())
            for doc, ids in zip(docs, enc.encode(texts)):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    yield doc, k, at // 4, ids[at:at + 4 * capacity]

    def run(batches):
        yield from _packed(items(batches), capacity, most, TaskContext.get().partitionId() << 32, hold=True)

    return run


def _pieces_to_sequences(capacity: int, most: int):
    def items(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("doc", "piece", "start", "ids")))

    def run(batches):
        yield from _packed(items(batches), capacity, most, 1 << 62 | TaskContext.get().partitionId() << 32, hold=False)

    return run


def sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
              open_bins: int = OPEN_BINS, end_id: int = 0, remember: int = 350_000) -> DataFrame:
    """One row per packed sequence: parallel arrays of its pieces, its ids (little-endian uint32), ``filled``, ``sequence``.

    A document is its token ids and ``end_id``; only documents longer than ``capacity`` are cut.
    Each task packs its documents as they come, with ``open_bins`` open bins.  What is still
    open at a task's end (at most ``open_bins`` sequences a task, a share that falls as tasks grow)
    is packed again, largest piece first, in groups of about ``LEFT_OVER`` pieces; no other ids move.

    ``remember`` bounds the words whose ids a worker keeps (about 0.5 KB each); it changes the time, not the result.
    Null texts count as empty and give ``end_id`` alone.  Null ids and repeated rows are packed
    like others.  Further columns are ignored.  An empty table gives an empty result.
    """
    base = given(docs, doc=id_col, text=text_col).select(F.col("doc").cast("long"), text_or_empty().alias("text"))
    first = written(mapped(base, _texts_to_sequences(tokenizer, capacity, open_bins, end_id, remember), SEQUENCES), "packed")
    left = pieces(first.filter("open")).select("doc", "piece", "start", "length", "ids")
    tasks = max(1, -(-first.filter("open").agg(F.coalesce(F.sum(F.size("docs")), F.lit(0))).first()[0] // LEFT_OVER))
    again = left.repartition(tasks).sortWithinPartitions(F.desc("length"), "doc", "piece", "start").select("doc", "piece", "start", "length", "ids")
    again = mapped(again, _pieces_to_sequences(capacity, 2 * LEFT_OVER), SEQUENCES)
    return first.filter("NOT open").unionByName(again).drop("open")


def pieces(packed: DataFrame) -> DataFrame:
    """One row per piece of packed sequences: ``(doc, piece, start, length, ids, sequence, offset)``."""
    each = packed.select("sequence", F.col("ids").alias("all"), F.explode(F.arrays_zip("docs", "pieces", "starts", "lengths", _offsets().alias("offset"))).alias("p"))
    return each.select(
        F.col("p.docs").alias("doc"), F.col("p.pieces").alias("piece"), F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"),
        F.expr("substring(all, int(4 * p.offset + 1), int(4 * p.lengths))").alias("ids"), "sequence", F.col("p.offset").alias("offset"))


def _offsets():
    return F.expr("transform(lengths, (x, i) -> aggregate(slice(lengths, 1, i), 0L, (a, b) -> a + b))")
