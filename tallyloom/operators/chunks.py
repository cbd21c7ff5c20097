"""Documents to chunks.  A document's pages and chunks stay inside its row until the final
explode, so chunk numbering needs no shuffle."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..scale import ship_package

# Separators from coarse to fine, and default sizes.
SEPARATORS = ["\n\n", "\n", ". ", " "]
CHUNK_SIZE, CHUNK_OVERLAP = 512, 50


def fixed_width(text, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Slices of ``size`` characters that start every ``size - overlap`` characters."""
    t = F.col(text) if isinstance(text, str) else text
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(t) > 0, F.transform(starts, lambda i: F.substring(t, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def split_text(text: str, size: int, overlap: int, parity: bool = False, level: int = 0) -> list[str]:
    """Chunks of one text: pack pieces up to ``size``, cut oversized pieces at a finer separator.

    ``parity=True`` keeps the reference behaviour of doubling separators inside a chunk and
    stripping separator characters from the last one.
    """
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    if level >= len(SEPARATORS):
        return [text[i:i + size] for i in range(0, len(text), size - overlap)]
    sep = SEPARATORS[level]
    glue = sep if parity else ""
    raw = text.split(sep)
    pieces = [p + sep for p in raw[:-1]] + raw[-1:]
    out, pack, used = [], [], 0

    def flush(last=False):
        nonlocal pack, used
        if pack:
            joined = glue.join(pack)
            out.append((joined.rstrip(sep) if last else joined) if parity else joined.strip())
        pack, used = [], 0

    for piece in pieces:
        if len(piece) > size:
            flush()
            out.extend(split_text(piece, size, overlap, parity, level + 1))
            continue
        if pack and used - len(glue) + len(piece) > size:
            flush()
        pack.append(piece)
        used += len(piece) + len(glue)
    flush(last=True)
    return [c for c in out if c.strip()]


def pack_sentences(text: str, size: int) -> list[str]:
    """Whole sentences packed up to ``size`` characters; a longer sentence stands alone."""
    import re

    out, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        if cur and len(cur) + 1 + len(s) > size:
            out.append(cur)
            cur = s
        else:
            cur = f"{cur} {s}" if cur else s
    return out + [cur] if cur else out


#: Words whose full stop ends no sentence, in lower case.
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "vs", "etc", "e.g", "i.e", "cf", "al", "fig", "no", "nr", "vol", "pp", "dhr", "mevr", "drs", "ir",
                 "bijv", "o.a", "d.w.z", "m.b.t", "z.b", "bzw", "ca", "approx", "dept", "inc", "ltd"]
_BLANKS = r"[\x20\x09-\x0D\x1C-\x1F]+"
SENTENCE_END = r"""[.!?\x{2026}]["'\x{201D}\x{2019}\x{BB})\]]*$"""
NO_END = r"""^["'\x{201C}\x{2018}\x{AB}(\[]*([A-Z]|(?i:""" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r"""))\.["'\x{201D}\x{2019}\x{BB})\]]*$"""


def sentences(text) -> Column:
    """Sentences of a text, blanks collapsed, in columns alone.

    A word ends one when it closes with ``.``, ``!``, ``?`` or an ellipsis, quotes and brackets behind it included, unless it is an
    abbreviation or an initial, or the next word begins with a small ASCII letter.  Decimals hold no blank, so they end none.
    """
    t = F.col(text) if isinstance(text, str) else text
    # one pass over the text: a word that ends a sentence gets a mark, which is no part of any word, before the blank behind it
    no_end = NO_END.removeprefix("^").removesuffix("$").replace("([A-Z]", "(?:[A-Z]", 1)
    last = f"(?<![^ ])(?!{no_end} )([^ ]*{SENTENCE_END.removesuffix('$')}) (?![a-z])"
    marked = F.regexp_replace(F.trim(F.regexp_replace(t, _BLANKS, " ")), last, "$1\x1e ")
    return F.filter(F.split(marked, "\x1e ?"), lambda s: s != "")


def packed_sentences(found: Column, budget: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> tuple[Column, Column]:
    """Two columns: ``__counted``, the words of each sentence, and, worked out from that one, ``array<struct<start,end>>`` of sentence
    positions: greedy chunks of at most ``budget`` words, one longer sentence alone.

    A chunk begins again with the last sentences of the one before, as many as have ``overlap`` words together and leave room for the
    next sentence, but never with all of them.  One pass over the sentences; what it carries is bounded by ``overlap``.
    """
    last = f"slice(a.tail, greatest(size(a.tail) - {overlap} + 1, 1), {overlap})" if overlap else "slice(a.tail, 1, 0)"
    again = f"""aggregate(reverse({last}), named_struct('sum', 0, 'k', 0, 'open', true),
        (b, v) -> if(b.open AND b.sum + v <= least({overlap}, {budget} - x.n), named_struct('sum', b.sum + v, 'k', b.k + 1, 'open', true), named_struct('sum', b.sum, 'k', b.k, 'open', false)))"""
    closed = f"""transform(array({again}), g -> named_struct('at', x.i - g.k, 'used', g.sum + x.n,
        'tail', if(g.k > 0, array_append(slice(a.tail, size(a.tail) - g.k + 2, g.k - 1), x.n), slice(a.tail, 1, 0)),
        'done', array_append(a.done, named_struct('start', a.at, 'end', x.i - 1))))[0]"""
    added = f"named_struct('at', a.at, 'used', a.used + x.n, 'tail', if(a.used > 0, array_append({last}, x.n), a.tail), 'done', a.done)"
    counted = F.transform(found, lambda s, i: F.struct(i.cast("int").alias("i"), F.size(F.split(s, " ")).alias("n")))
    packs = F.expr(f"""aggregate(__counted, named_struct('at', 0, 'used', 0, 'tail', cast(array() AS array<int>), 'done', cast(array() AS array<struct<start:int,end:int>>)),
        (a, x) -> if(a.used > 0 AND a.used + x.n > {budget}, {closed}, {added}),
        a -> if(a.used > 0, array_append(a.done, named_struct('start', a.at, 'end', size(__counted) - 1)), a.done))""")
    return counted, packs


def sentence_chunks(docs: DataFrame, text: str, budget: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, out: str = "chunks") -> DataFrame:
    """``docs`` with ``out``: whole sentences of ``text`` in chunks of at most ``budget`` words, ``overlap`` words of them again in the next.

    No worker and no shuffle; a text without words has no chunks.  Each step is worked out once: the filter that Spark derives from
    an explode of ``out`` would else find the sentences anew for every chunk.
    """
    counted, packs = packed_sentences(F.col("__found"), budget, overlap)
    d = once(once(docs, "__found", sentences(text)).withColumn("__counted", counted), "__packs", packs)
    joined = F.transform("__packs", lambda p: F.array_join(F.slice("__found", p["start"] + 1, p["end"] - p["start"] + 1), " "))
    kept = [c for c in docs.columns if c != out]
    return once(d.select(*kept, F.coalesce(joined, F.array().cast("array<string>")).alias("__out")), out, F.col("__out")).drop("__out")


#: Characters of chunks that a Python worker holds before it hands them on.
_HELD = 1 << 20


def cutter(strategy: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, parity: bool = False):
    """Python function of one page text for the strategies that need one, else None."""
    if strategy in ("recursive", "character"):
        return lambda t: split_text(t, size, overlap, parity)
    if strategy == "semantic":
        return lambda t: pack_sentences(t, size)
    if strategy == "fixed":
        return None
    raise ValueError(f"unknown chunking strategy: {strategy}")


def cut_batches(batches, cut, names: list[str]):
    """Arrow rows (doc, page texts) to rows (doc, chunk_index, page, text), at most ``_HELD`` characters and one document at a time."""
    for batch in batches:
        at, index, page, texts, held = [], [], [], [], 0
        for row in range(batch.num_rows):
            n = 0
            for i, p in enumerate(batch.column(1)[row].as_py() or [], 1):
                for c in cut(p or "") or ([""] if not (p or "").strip() else []):
                    at.append(row), index.append(n), page.append(i), texts.append(c)
                    n, held = n + 1, held + len(c)
            if at and (held > _HELD or len(at) > 10_000 or row + 1 == batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(page, pa.int32()), pa.array(texts, pa.string())], names)
                at, index, page, texts, held = [], [], [], [], 0


def chunked(docs: DataFrame, doc: str, pages: Column, strategy: str = "recursive", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, parity: bool = False) -> DataFrame:
    """(doc, chunk_index, page_number, raw_text) rows of a strategy."""
    cut, names = cutter(strategy, size, overlap, parity), ["doc", "chunk_index", "page_number", "raw_text"]
    if cut is None:
        c = docs.withColumn("__chunks", fixed_pages(pages, size, overlap)).select(doc, F.posexplode("__chunks").alias("chunk_index", "c"))
        return c.select(doc, "chunk_index", F.col("c.page").alias("page_number"), F.col("c.text").alias("raw_text"))
    ship_package(docs.sparkSession)
    given = docs.select(F.col(doc).alias("doc"), pages.alias("pages"))
    schema = f"doc {given.schema['doc'].dataType.simpleString()}, chunk_index int, page_number int, raw_text string"
    return given.mapInArrow(lambda batches: cut_batches(batches, cut, names), schema).withColumnRenamed("doc", doc)


def fixed_pages(pages: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of page texts -> array<struct<page,text>> of slices; a blank page has one empty slice."""
    per = F.transform(pages, lambda p, i: F.transform(
        F.when(tx.collapse(p) == "", F.array(F.lit(""))).otherwise(fixed_width(p, size, overlap)),
        lambda c: F.struct((i + 1).cast("int").alias("page"), c.alias("text"))))
    return F.flatten(per)


def chunker(strategy: str = "recursive", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, parity: bool = False):
    """Column function: array of page texts -> array<struct<page,text>> for a strategy name.  ``chunked`` gives rows and holds less."""
    cut = cutter(strategy, size, overlap, parity)
    if cut is None:
        return lambda pages: fixed_pages(pages, size, overlap)

    def run(pages: pd.Series) -> pd.Series:
        def one(ps):
            return [{"page": i, "text": c} for i, p in enumerate(ps, 1) for c in (cut(p or "") or ([""] if not (p or "").strip() else []))]

        return pages.map(one)

    return lambda pages: F.pandas_udf(run, "array<struct<page:int,text:string>>")(pages)


def once(df: DataFrame, name: str, col: Column) -> DataFrame:
    """``df`` with a costly column that later filters and columns read but do not work out again (filters do not pass a generator)."""
    return df.select("*", F.explode(F.array(col)).alias(name))


def chunk_table(docs: DataFrame, doc: str, pages: Column, strategy: str = "recursive", clean: bool = True,
                min_length: int = tx.MIN_LENGTH, normalize: bool = True, **sizes) -> DataFrame:
    """One row per chunk: index across pages, ids, page, hash; unusable chunks stay, blank and flagged."""
    c = chunked(docs, doc, pages, strategy, **sizes)
    if clean:
        c = once(c, "__clean", tx.clean_text("raw_text", normalize=normalize))
        c = once(c, "text", F.coalesce(tx.keep_if_useful(F.col("__clean"), min_length), F.lit(""))).drop("__clean")
    else:
        c = c.withColumn("text", F.col("raw_text"))
    return c.select(doc, "chunk_index", F.concat_ws("_", F.col(doc).cast("string"), F.col("chunk_index")).alias("document_id"), "page_number", "text",
                    (F.col("text") == "").alias("is_empty_page"), F.sha2("text", 256).alias("content_hash"),
                    F.length("raw_text").alias("raw_length"))


def page_chunks(chunks: DataFrame, doc: str) -> DataFrame:
    """Chunks per page as an ordered list (a page's chunks are slices of one page text)."""
    g = chunks.groupBy(doc, "page_number").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("chunks"))
    return g


def chunk_stats(docs: DataFrame, doc: str, pages: Column, chunks: DataFrame) -> DataFrame:
    """Per document: chunk counts, mean length and letter share, hash of the page texts."""
    g = chunks.groupBy(doc).agg(F.count("*").alias("total_chunks"), F.count_if(F.col("is_empty_page")).alias("filtered_chunks"),
                                F.avg(F.length("text")).alias("mean_length"), F.avg(tx.alnum_ratio("text")).alias("mean_alnum"))
    h = docs.select(doc, F.sha2(F.array_join(pages, "\n"), 256).alias("document_hash"))
    return h.join(g, doc, "left").na.fill(0)


def records_to_embed(chunks: DataFrame, doc: str, max_pages: int | None = None) -> DataFrame:
    """Non-empty chunks, within the page limit; one key (the chunk's document_id) for text and vector."""
    c = chunks.filter(~F.col("is_empty_page"))
    return c.filter(F.col("page_number") <= max_pages) if max_pages else c


def embed(chunks: DataFrame, model, out: str = "embedding") -> DataFrame:
    """Add vectors with a caller's batch function ``model(list[str]) -> list[list[float]]``."""

    def run(it):
        for s in it:
            yield pd.Series(list(model(s.tolist())))

    from typing import Iterator

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return chunks.withColumn(out, F.pandas_udf(run, "array<float>")(F.col("text")))
