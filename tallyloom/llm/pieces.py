"""SentencePiece encoding and decoding by a streaming Viterbi pass."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given, mapped

SPACE = "▁"


def check_kind(path: str) -> None:
    """Refuse models that this lattice would encode otherwise than the library: no other kind is taken for one built by merging."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kind, rules = model.trainer_spec, model.normalizer_spec
    if kind.model_type != kind.BPE:
        raise ValueError(f"{path}: only models built by merging; unigram, word and character models need path scores")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix or kind.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: only models that keep the text as it is and put a space mark before words")


class Lattice:
    """The pieces of a model and which of them may follow each other.

    In a model built by merging, the encoding of a text is the one segmentation in which every two
    neighbouring pieces are what merging makes of the two alone; each prefix of a text has exactly
    one such path.  A Viterbi step therefore keeps, for every end, the one piece whose
    predecessor path admits it.  Characters without a piece become bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        check_kind(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.bytes_at = {int(n[3:5], 16): i for i, n in enumerate(self.names) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes_at.items()}
        self.unknown = model.unk_id()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.rank = {self.names[i]: -model.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.starts_words = all(SPACE not in n.lstrip(SPACE) and (n.strip(SPACE) == "" or n.count(SPACE) <= 1) for n in self.ids)
        #: Neighbouring characters inside pieces: between any others every path has a boundary.
        self.joints = {n[i:i + 2] for n in self.ids for i in range(len(n) - 1)}
        self.lines_apart = not any("\n" in n and n != "\n" for n in self.ids)
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)]
        self.steps: dict[str, tuple] = {}
        self.codes: dict[str, bytes] = {}
        self.sound = {p for p in self.ids if self._merged(p)[0] == [p]}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """Merging of a short string, the best-ranked neighbours first and the leftmost among equals:
        what is left, and before each step its rank with the leftmost and rightmost part."""
        parts, order = list(text), []
        while True:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=(math.inf, 0))
            order.append((best[0], parts[0], parts[-1]))
            if best[0] == math.inf:
                return parts, order
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def _order(self, piece: str) -> tuple:
        found = self.steps.get(piece)
        if found is None:
            found = self.steps[piece] = tuple(self._merged(piece)[1])
            if len(self.steps) > 100_000:
                self.steps.clear()
        return found

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' characters never joins across their border."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self._apart(self._order(left), self._order(right))
        return known

    def _apart(self, one: tuple, two: tuple) -> bool:
        i = j = 0
        rank = self.rank.get
        while True:
            mine, _, a = one[i]
            other, b, _ = two[j]
            across = rank(a + b, math.inf)
            if across < mine and across <= other:
                return False
            if mine == math.inf and other == math.inf:
                return True
            if mine <= other:
                i += 1
            else:
                j += 1

    def last_piece(self, window: str, end: int, ends: dict[int, str], base: int) -> str:
        """The last piece of the encoding of a prefix, given those of all shorter prefixes in the window."""
        pairs, sound = self.pairs, self.sound
        for start in range(max(base, end - self.longest), end - 1):
            piece = window[start - base:end - base]
            if piece in sound and start in ends:
                before = ends[start]
                if not before:
                    return piece
                known = pairs.get((before, piece))
                if known or known is None and self.fits(before, piece):
                    return piece
        return window[end - base - 1:end - base]

    def stream(self, chars: str) -> Iterator[str]:
        """Pieces of a text, each as soon as all paths that can still grow run through it.

        Kept are the last ``longest`` ends with their backpointers; when the paths of all kept ends
        share a boundary, everything up to it is committed and let go.
        """
        longest, ends, base, window = self.longest, {0: ""}, 0, chars[:8 * self.longest]
        for end in range(1, len(chars) + 1):
            if end - base > len(window):
                window = chars[base:end + 8 * longest]
            ends[end] = self.last_piece(window, end, ends, base)
            if end - base >= 4 * longest:
                live = range(end - longest + 1, end + 1)
                meet = set(live)
                while len(meet) > 1:  # walk the furthest path back by one piece until one boundary is left
                    far = max(meet)
                    if far - len(ends[far]) < base:
                        break
                    meet.remove(far)
                    meet.add(far - len(ends[far]))
                if len(meet) == 1 and (stop := meet.pop()) > base:
                    yield from self._path(ends, base, stop)
                    for e in range(base, stop):
                        ends.pop(e, None)
                    base, window = stop, chars[stop:end + 8 * longest]
        yield from self._path(ends, base, len(chars))

    @staticmethod
    def _path(ends: dict[int, str], start: int, stop: int) -> list[str]:
        out = []
        while stop > start:
            out.append(ends[stop])
            stop -= len(ends[stop])
        return out[::-1]

    def code(self, piece: str) -> bytes:
        """The ids of a piece as bytes; a character without a piece is its UTF-8 bytes' ids, or unknown."""
        found = self.codes.get(piece)
        if found is None:
            if piece in self.ids:
                ids = [self.ids[piece]]
            else:
                ids = [self.bytes_at[b] for b in piece.encode()] if self.bytes_at else [self.unknown]
            found = self.codes[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def short(self, word: str) -> bytes:
        """The same steps for a word that fits the window whole."""
        longest, pairs, sound, ends = self.longest, self.pairs, self.sound, [""]
        for end in range(1, len(word) + 1):
            for start in range(end - longest if end > longest else 0, end - 1):
                piece = word[start:end]
                if piece in sound:
                    before = ends[start]
                    if not start:
                        break
                    known = pairs.get((before, piece))
                    if known is None:
                        known = self.fits(before, piece)
                    if known:
                        break
            else:
                piece = word[end - 1]
            ends.append(piece)
        out, at, codes = [], len(word), self.codes
        while at:
            piece = ends[at]
            out.append(codes.get(piece) or self.code(piece))
            at -= len(piece)
        out.reverse()
        return b"".join(out)


class Codec:
    """Encodes and decodes whole texts; words are encoded once while they are remembered."""

    def __init__(self, path: str, remember: int = 500_000):
        self.lattice, self.remember, self.known, self.older = Lattice(path), remember, {}, {}

    def _word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = self.older.get(word)
            if found is not None:
                self.known[word] = found
                return found
            if len(word) > 64:
                return b"".join(map(self.lattice.code, self.lattice.stream(word)))
            if len(word) > 1 and word[-2:] not in self.lattice.joints:
                found = self._word(word[:-1]) + self.lattice.code(word[-1])
            else:
                found = self.lattice.short(word)
            if len(self.known) >= self.remember:
                self.known, self.older = {}, self.known
            self.known[word] = found
        return found

    def _words(self, chars: str) -> Iterator[str]:
        """No piece crosses from a character into a following space mark: there all paths meet."""
        if not self.lattice.starts_words:
            yield chars
            return
        at = 0
        while at < len(chars):
            run = at
            while run < len(chars) and chars[run] == SPACE:
                run += 1
            end = chars.find(SPACE, run)
            end = len(chars) if end < 0 else end
            yield chars[at:end]
            at = end

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids.  A space mark is put before a text that is not empty."""
        if not text:
            return b""
        chars = SPACE + text.replace(" ", SPACE)
        if not self.lattice.starts_words or not self.lattice.lines_apart or SPACE * 2 in chars:
            return b"".join(map(self._word, self._words(chars)))
        word, out = self._word, []
        for line in chars.split("\n"):  # no piece crosses a line break either
            head, *rest = line.split(SPACE)
            known = self.known.get
            out.append((word(head) if head else b"") + b"".join([known(w) or word(w) for w in map(SPACE.__add__, rest)]))
        return self.lattice.code("\n").join(out)

    def decode(self, ids: bytes) -> str:
        """Pieces and bytes put together; bytes that are no UTF-8 become U+FFFD."""
        raw = self.lattice.raw.__getitem__
        return b"".join(map(raw, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")[1:]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)``: the ids of each text as little-endian unsigned 32-bit integers in one binary.

    Equal to the model's own encoder, without begin and end marks.  Null texts give null, empty ones an
    empty binary.  Null ids and repeated rows are encoded like others; further columns are ignored.
    """
    base = given(docs, id=id_col, text=text_col)

    def run(batches):
        own = codec(model)
        for batch in batches:
            out = [None if t is None else own.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "ids"])

    return mapped(base, run, f"id {dict(base.dtypes)['id']}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)`` from ids.  Null ids-binaries give null.  A text whose characters include the space mark comes back with blanks."""
    base = given(encoded, id=id_col, ids=ids_col)

    def run(batches):
        own = codec(model)
        for batch in batches:
            out = [None if i is None else own.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "text"])

    return mapped(base, run, f"id {dict(base.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_ids, ids_crc32, decoded_sha256)`` of each text, from one pass over it."""
    base = given(docs, id=id_col, text=text_col)

    def run(batches):
        own = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [None if t is None else own.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(ids, pa.binary()), pa.array([None if i is None else own.decode(i) for i in ids], pa.string())],
                    ["id", "ids", "decoded"])

    out = mapped(base, run, f"id {dict(base.dtypes)['id']}, ids binary, decoded string")
    return out.select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
