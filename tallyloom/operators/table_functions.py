"""Chunkers and document processors for SQL: table functions to be used with LATERAL, and scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.text import EMPTY_HTML, _Text
from ..scale import ship_package
from .chunks import CHUNK_OVERLAP, CHUNK_SIZE, pack_sentences, split_text

CHUNKS = T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())])


def _number(args: tuple, at: int, default: int, what: str, least: int) -> int:
    """A constant whole number at that place of the call, or the default."""
    if len(args) <= at:
        return default
    if not args[at].isConstantExpression or not isinstance(args[at].value, int) or args[at].value < least:
        raise ValueError(f"{what}: a constant of at least {least}")
    return args[at].value


def _text_first(args: tuple) -> None:
    if not args or not isinstance(args[0].dataType, (T.StringType, T.NullType)):
        raise ValueError("the first argument is the text")


class _Chunks:
    """What the chunkers share: (text [, size [, overlap]]) gives one row a chunk; no rows for null or blank texts."""

    @staticmethod
    def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
        _text_first(args)
        if len(args) > 3:
            raise ValueError("text, size and overlap, no more")
        size = _number(args, 1, CHUNK_SIZE, "size", 1)
        if _number(args, 2, min(CHUNK_OVERLAP, size - 1), "overlap", 0) >= size:
            raise ValueError("overlap: less than size")
        return AnalyzeResult(CHUNKS)

    def cut(self, text: str, size: int, overlap: int) -> list[str]:
        raise NotImplementedError

    def eval(self, text, size=CHUNK_SIZE, overlap=None):
        if text is not None and text.strip():
            yield from enumerate(self.cut(text, size, min(CHUNK_OVERLAP, size - 1) if overlap is None else overlap))


class FixedChunks(_Chunks):
    """Slices of ``size`` characters that start every ``size - overlap`` characters."""

    def cut(self, text, size, overlap):
        return [text[i:i + size] for i in range(0, len(text), size - overlap)]


class RecursiveChunks(_Chunks):
    """Paragraphs, lines, sentences and words packed up to ``size`` characters."""

    def cut(self, text, size, overlap):
        return split_text(text, size, overlap)


class SentenceChunks(_Chunks):
    """Whole sentences packed up to ``size`` characters."""

    def cut(self, text, size, overlap):
        return pack_sentences(text, size)


class HtmlDocument:
    """(html) gives one row: the text of a page and its headings."""

    @staticmethod
    def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
        _text_first(args)
        return AnalyzeResult(T.StructType([T.StructField("text", T.StringType()), T.StructField("headings", T.ArrayType(T.StringType()))]))

    def eval(self, html):
        page = _Text()
        page.feed(html or "")
        yield "".join(page.parts).strip() or EMPTY_HTML, page.titles


TABLE_FUNCTIONS = {"chunk_fixed": FixedChunks, "chunk_recursive": RecursiveChunks, "chunk_sentences": SentenceChunks, "html_document": HtmlDocument}


def register(spark: SparkSession) -> list[str]:
    """Make the table functions known to SQL: ``SELECT d.id, c.* FROM docs d, LATERAL chunk_recursive(d.text, 512, 50) c``."""
    ship_package(spark)
    for name, handler in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler))
    return sorted(TABLE_FUNCTIONS)


def register_scorer(spark: SparkSession, name: str, load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> None:
    """A scorer of (question, text) pairs as an SQL function: ``load()`` runs once in each task, its result on each batch."""

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for questions, texts in batches:
            yield pd.Series(model(questions.fillna("").tolist(), texts.fillna("").tolist()), dtype="float64")

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    spark.udf.register(name, F.pandas_udf(score, "double"))
