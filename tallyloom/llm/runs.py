"""Periodic runs of words by internal pattern matching over dyadic blocks."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given, mapped, text_or_empty

#: Words that are indexed together; a longer document is indexed alone.
TOGETHER = 1 << 17
LEAST = 12
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Dyadic:
    """Suffix array of a sequence with the classes of its blocks of 1, 2, 4 ... symbols, by doubling.

    ``ranks[k][i]`` is the first slot of the suffix array whose suffix begins with the 2^k symbols at i.  Slots of one
    symbol sequence stay together at every later level, so a class is a range of slots.  Only classes of two and more are sorted on.
    The sequence must end with a symbol that occurs once.
    """

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        self.slots = np.argsort(seq, kind="stable").astype(np.int32)
        ranks = np.empty(n, np.int32)
        key = seq[self.slots]
        live = np.arange(n)
        self.ranks: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        where = self.slots
        while True:
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[new, len(key)])
            ranks[where] = np.repeat(live[new], size)
            self.ranks.append(ranks)
            sizes = np.ones(n, np.int32)
            sizes[live[new]] = size
            self.sizes.append(sizes)
            more = np.repeat(size > 1, size)
            live, where = live[more], where[more]
            if not len(live):
                return
            h = 1 << (len(self.ranks) - 1)
            key = ranks[where].astype(np.int64) * n + ranks[where + h]
            order = np.argsort(key, kind="stable")
            key, where = key[order], where[order]
            self.slots[live] = where
            ranks = ranks.copy()

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on agree; i < j."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            step = (rank[a] == rank[b]).astype(np.int64) << k
            a += step
            b += step
        return a - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i and before j agree; i < j."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, h = self.ranks[k], 1 << k
            step = ((a >= h) & (rank[np.maximum(a - h, 0)] == rank[np.maximum(b - h, 0)])).astype(np.int64) << k
            a -= step
            b -= step
        return i - a


class Wavelet:
    """Wavelet matrix over distinct numbers: the least number of a range of slots that is at least x."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros, self.split = [], []
        for b in range(self.bits - 1, -1, -1):
            low = (values >> b & 1) == 0
            self.zeros.append(np.r_[0, np.cumsum(low)].astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            values = np.r_[values[low], values[~low]]

    def _less(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for k, (zeros, split) in enumerate(zip(self.zeros, self.split)):
            zl, zh = zeros[lo], zeros[hi]
            one = (x >> (self.bits - 1 - k) & 1) == 1
            out += np.where(one, zh - zl, 0)
            lo, hi = np.where(one, split + lo - zl, zl), np.where(one, split + hi - zh, zh)
        return out

    def _at(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), np.int64)
        for zeros, split in zip(self.zeros, self.split):
            zl, zh = zeros[lo], zeros[hi]
            one = place >= zh - zl
            place = place - np.where(one, zh - zl, 0)
            out = out << 1 | one
            lo, hi = np.where(one, split + lo - zl, zl), np.where(one, split + hi - zh, zh)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        """For each range and x the least value >= x, or ``none``."""
        out = np.full(len(x), none, np.int64)
        within = np.flatnonzero(x < 1 << self.bits)
        lo, hi, x = lo[within], hi[within], x[within]
        place = self._less(lo, hi, x)
        has = place < hi - lo
        out[within[has]] = self._at(lo[has], hi[has], place[has])
        return out


def _level(index: Dyadic, tree: Wavelet, slot: np.ndarray, k: int, none: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate (position, period) pairs of the blocks of 2^k words.

    A run of period p covers max(12, 2p) words, so its first max(12 - p, p) hold a block of the level that p belongs to, and the
    block occurs again p further on.  Occurrences at most half a block apart are a progression, all in one stretch of
    that smaller period: if it is the block's own stretch, the smaller period, a lower level's, says it all; if it begins beyond the end of that,
    stretches must fall on stretches, which leaves two periods; else each member is a candidate.
    """
    m = 1 << k
    near, far = (1, 14) if k == 2 else (2 * m - 1, 4 * m - 2)
    rank, sizes = index.ranks[k], index.sizes[k]
    i = np.arange(0, len(rank), 2 if k == 2 else m)
    i = i[sizes[rank[i]] > 1]
    lo = slot[rank[i]]
    hi = lo + sizes[rank[i]]
    o = tree.successor(lo, hi, i + near, none)
    while True:
        here = o <= i + far
        i, lo, hi, o = i[here], lo[here], hi[here], o[here]
        if not len(i):
            return
        then = tree.successor(lo, hi, o + 1, none)
        many = then - o <= m // 2
        yield i[~many], (o - i)[~many]
        at = np.flatnonzero(many)
        if len(at):
            u, v = i[at], o[at]
            q = then[at] - v
            a1, b1 = u - index.behind(u, u + q), u + q + index.ahead(u, u + q)
            a2, b2 = v - index.behind(v, v + q), v + q + index.ahead(v, v + q)
            apart, touching = a2 > b1, (a2 <= b1) & (a1 != a2)
            if k == 2:  # no lower level finds the smaller period
                yield u, q
            yield u[apart], (a2 - a1)[apart]
            yield u[apart], (b2 - b1)[apart]
            u, v, q, last = u[touching], v[touching], q[touching], np.minimum(b2 - m, i[at] + far)[touching]
            members = (last - v) // q + 1
            turn = np.arange(members.sum()) - np.repeat(np.cumsum(members) - members, members)
            yield np.repeat(u, members), np.repeat(v - u, members) + turn * np.repeat(q, members)
            then[at] = tree.successor(lo[at], hi[at], b2 - m + 1, none)
        o = then


def runs_of(seq: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run of at least ``least`` (12 or more) symbols and two periods, by start and period.

    ``seq``: numbers, the last of which occurs once.
    """
    index, none = Dyadic(seq), len(seq) << 2
    found = [(np.zeros(0, np.int64),) * 3]
    if len(index.ranks) > 2:
        rank, sizes = index.ranks[2], index.sizes[2]
        shared = sizes[rank[index.slots]] > 1  # only classes of two and more are asked for
        tree = Wavelet(index.slots[shared].astype(np.int64))
        slot = np.r_[0, np.cumsum(shared)]
        for k in range(2, len(index.ranks)):
            for i, p in _level(index, tree, slot, k, none):
                inside = i + p < len(seq)
                i, p = i[inside], p[inside]
                start, end = i - index.behind(i, i + p), i + p + index.ahead(i, i + p)
                good = end - start >= np.maximum(least, 2 * p)
                found.append((start[good], end[good], p[good]))
    start, end, p = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((p, end, start))  # of several periods of one stretch the smallest
    start, end, p = start[order], end[order], p[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][:len(start)]
    start, end, p = start[first], end[first], p[first]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document (by crc32 of its id), periodic from some word on; of others as they are."""
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _group(docs: list[int | None], texts: list[list[bytes]], least: int) -> pa.RecordBatch:
    names: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in texts])
    firsts = np.r_[0, np.cumsum(sizes + 1)]  # a separator of its own ends each text
    seq = np.empty(firsts[-1], np.int64)
    for at, words in zip(firsts, texts):
        seq[at:at + len(words)] = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    seq[firsts[1:] - 1] = len(names) + np.arange(len(texts))
    start, end, period = runs_of(seq, least)
    cuts = np.searchsorted(start, firsts)
    each, left = [], []
    for k, words in enumerate(texts):
        mine = slice(cuts[k], cuts[k + 1])
        s, e, p = (x[mine] - base for x, base in ((start, firsts[k]), (end, firsts[k]), (period, 0)))
        each.append([{"start": a, "length": b - a, "period": c} for a, b, c in zip(s.tolist(), e.tolist(), p.tolist())])
        if len(s):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, s + p, 1)
            np.add.at(edge, e, -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
        left.append(b" ".join(words).decode())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(each, pa.list_(RUN)), pa.array(left, pa.string())],
                                      ["doc", "n_words", "runs", "collapsed"])


def _found(plant: bool, least: int):
    def run(batches):
        docs, texts, words = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                found = text.as_py().encode().split()  # bytes are split at \x20 and \x09 to \x0D, nowhere else
                if words + len(found) > TOGETHER and texts:
                    yield _group(docs, texts, least)
                    docs, texts, words = [], [], 0
                docs.append(doc)
                texts.append(planted(doc, found) if plant else found)
                words += len(found)
        if texts:
            yield _group(docs, texts, least)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, plant: bool = False) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for every row: runs of words as (start, length, period), and the text without repetitions.

    A run is a stretch of at least ``least`` (12 or more) words and two of its smallest period that neither neighbour extends.
    ``collapsed`` holds, joined by blanks, the words that no run contains beyond its first period.  ``plant`` makes every
    tenth document periodic first (see ``planted``).

    Documents are indexed in groups of 2^17 words, whole, a longer one alone, with about 200 bytes a word; all steps are in
    n log n of a group, however periodic it is.  Nothing is shuffled.  Null and empty texts have no words and no runs.
    Null ids and repeated rows are taken like others.  Further columns are ignored.  An empty table gives an empty result.
    """
    if least < LEAST:
        raise ValueError(f"least: blocks of four words find runs of {LEAST} words or more")
    base = given(docs, doc=id_col, text=text_col).select(F.col("doc").cast("long"), text_or_empty().alias("text"))
    return mapped(base, _found(plant, least), FOUND).withColumnRenamed("doc", "doc_id")


def digests(found: DataFrame) -> list[Column]:
    """Columns of the longest run (null without runs) and of digests of all runs and of the collapsed text."""
    # the greatest length, then the smallest start, then the smallest period
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return [F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
            F.floor(1000 * best["length"] / -best["period"]).alias("exponent_milli"),
            F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
