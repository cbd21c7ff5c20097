"""Quality by compression: how much better a text compresses with a dictionary of good than of bad text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import first_per
from .common import given, mapped, text_or_empty

SAMPLE_ROWS = 2500
TEXT_BYTES = 1 << 15
DICTIONARY_BYTES = 110 << 10
SEGMENT = 2048
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the coefficients that turn compressed sizes into a score."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    segment: int = SEGMENT
    level: int = LEVEL


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def _sizes(text: bytes, compressors: list, segment: int) -> list[int]:
    """Compressed bytes of the whole text under each dictionary.  Segments keep a long text from teaching the compressor itself."""
    parts = [text[i:i + segment] for i in range(0, len(text), segment)] or [b""]
    return [sum(len(c.compress(p)) for p in parts) for c in compressors]


def _features(good: int, bad: int, plain: int, size: int, segments: int) -> tuple[float, ...]:
    """The normalised difference, and the sizes relative to the text, where repetition shows."""
    size = size + 16 * segments
    return (bad - good) / (bad + good), good / size, (good / size) ** 2, plain / size, (plain / size) ** 2


def features(text: bytes, compressors: list, segment: int) -> tuple[float, ...]:
    good, bad, plain = _sizes(text, compressors, segment)
    return _features(good, bad, plain, len(text), max(1, -(-len(text) // segment)))


def _engines(good: bytes, bad: bytes, level: int) -> list:
    return [_compressor(good, level), _compressor(bad, level), zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge on all weights but the constant."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, text_bytes: int = TEXT_BYTES) -> list:
    """At most ``rows`` labelled rows of each label, in the order of a hash of the text.

    Whole texts of up to ``text_bytes`` bytes; longer ones are not used to fit (all are scored).  Ranks
    are cut in each task before the shuffle, so at most ``2 * rows * text_bytes`` bytes reach the driver.
    """
    fit_for = labelled.filter(F.col("label").isin(0, 1) & (F.octet_length("text") > 0) & (F.octet_length("text") <= text_bytes))
    fit_for = fit_for.select("label", "text", F.expr("pmod(xxhash64(text, 12), 2)").alias("half"), F.xxhash64("text", F.lit(11)).alias("order"))
    return sorted(first_per(fit_for, ["label"], ["order", "text"], rows).collect(), key=lambda r: (r["label"], r["order"], r["text"]))


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES,
        segment: int = SEGMENT, level: int = LEVEL) -> Model | None:
    """Fit on ``labelled(text, label)``: one half of a bounded sample makes the dictionaries, the other calibrates.

    Returns None when one of the labels is missing: then nothing can be told.
    """
    taken = [(r["label"], r["text"].encode(), r["half"]) for r in sample(labelled, rows)]
    dictionaries = []
    for label in (1, 0):
        own = [t[i:i + segment] for y, t, half in taken if y == label and (half == 0) for i in range(0, len(t), segment)]
        own = own or [t for y, t, _ in taken if y == label]
        if not own:
            return None
        try:
            dictionaries.append(zstandard.train_dictionary(min(dictionary_bytes, max(1024, sum(map(len, own)) // 8)), own).as_bytes())
        except zstandard.ZstdError:  # too few samples for training: the text itself serves
            dictionaries.append(b"".join(own)[-dictionary_bytes:])
    engines = _engines(*dictionaries, level)
    other = [r for r in taken if r[2] == 1] or taken
    if len({y for y, _, _ in other}) < 2:
        other = taken
    x = np.array([features(t, engines, segment) for _, t, _ in other])
    y = np.array([label for label, _, _ in other], float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    return Model(*dictionaries, tuple(mean), tuple(scale), tuple(_logistic(z, y)), segment, level)


def _scorer(model: Model):
    engines = _engines(model.good, model.bad, model.level)

    def scores(texts: list[str]) -> np.ndarray:
        x = np.array([features(t.encode(), engines, model.segment) for t in texts]).reshape(-1, len(model.mean))
        z = np.column_stack([(x - model.mean) / model.scale, np.ones(len(x))])
        return 1 / (1 + np.exp(-np.clip(z @ np.array(model.weights), -30, 30)))

    return scores


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` for every row: the share of label 1 expected among texts that compress alike.

    Whole texts are read, in segments that are compressed one by one.  Null texts count as empty; an
    empty text gets the score of its (equal) compressed sizes.  Without a model every score is 0.5.
    Null ids and repeated rows are scored like others; further columns are ignored.
    """
    base = given(docs, id=id_col, text=text_col).select("id", text_or_empty().alias("text"))
    if model is None:
        return base.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"))

    def run(batches):
        scorer = _scorer(model)
        for batch in batches:
            p = scorer(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p, pa.float64())], ["id", "score"])

    return mapped(base, run, f"id {dict(base.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def filtered(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``least`` or better.  Nothing is shuffled: rows pass through the scorer."""
    place = docs.columns.index(text_col)

    def run(batches):
        scorer = _scorer(model)
        for batch in batches:
            p = scorer(["" if t is None else t for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(p >= least))

    return mapped(docs, run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          rows: int = SAMPLE_ROWS, **settings) -> Model | None:
    """Fit on labelled rows outside the held-out fold: at most ``rows`` labels of each kind, drawn by a hash of the id.

    The labels drawn are few (the broadcast holds ``4 * rows`` rows at most), so documents are
    filtered where they are read and no text is shuffled but the sample.  Null labels and ids teach nothing; a
    label row counts once.
    """
    marks = given(labels, id=id_col, label=label_col).filter(~held_out("id") & F.col("label").isin(0, 1)).distinct()
    marks = first_per(marks, ["label"], [F.xxhash64("id", F.lit(13)), "id"], 2 * rows)
    return fit(given(docs, id=id_col, text=text_col).join(F.broadcast(marks), "id").select("text", "label"), rows, **settings)
