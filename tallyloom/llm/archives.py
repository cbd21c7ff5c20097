"""WARC archives: writing, normalising whole-file gzip streams to one member per record, reading back by index."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, given, mapped, scratch_dir, text_or_empty, written

LEAST_SHARED = 100
ROLL_BYTES = 256 << 20
CHUNK = 1 << 20
# Fixed values of the WARC format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"
END = b"\r\n\r\n"

INDEX = "archive string, offset long, length long"
RECORDS = ("record_id string, type string, uri string, digest string, refers_to string, http_length long, payload binary")


def _store(uri: str):
    """A shared store as pyarrow opens it, and the path inside."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _clean(value: str) -> bytes:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value).encode()


def _record(kind: str, record_id: str, uri: str | None, digest: str, refers: str | None, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http + payload if kind == "response" else http
    head = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <%s>" % record_id.encode(), b"WARC-Date: " + DATE]
    if uri is not None:
        head.append(b"WARC-Target-URI: " + _clean(uri))
    head.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if kind == "revisit":
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <%s>" % refers.encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + END + block + END


def _writer(folder: str, roll: int):
    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        name, out, pack, size = None, None, None, 0
        done = []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("kind", "record_id", "uri", "digest", "refers", "text")]
            for kind, record_id, uri, digest, refers, text in zip(*cols):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, pack, size = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0
                raw = _record(kind, record_id, uri, digest, refers, text.encode())
                out.write(pack.compress(raw))
                size += len(raw)
                if size >= roll:
                    out.write(pack.flush())
                    out.close()
                    done.append(name)
                    out = None
        if out is not None:
            out.write(pack.flush())
            out.close()
            done.append(name)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in done], pa.string())], ["archive"])

    return run


def write_archives(records: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``records(kind, record_id, uri, digest, refers, text)`` as whole-file gzip streams; returns their places.

    Each task writes files under names of its own, so a repeated task leaves at most an unlisted file.
    """
    return written(mapped(records, _writer(folder, roll_bytes), "archive string"), "archives")


def _inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in pieces of bounded size."""
    engine = zlib.decompressobj(31)
    data = b""
    while data or (data := stream.read(CHUNK)):
        yield engine.decompress(data, CHUNK)
        if engine.eof:
            data, engine = engine.unused_data, zlib.decompressobj(31)
        else:
            data = engine.unconsumed_tail


class _Source:
    """A byte source that is read once, forward."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, b""

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.held += part
        return True

    def head(self) -> bytes | None:
        """Up to and with the blank line; None at the end."""
        while (at := self.held.find(END)) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("archive ends inside a record head")
                return None
        found, self.held = self.held[:at + 4], self.held[at + 4:]
        return found

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self._more():
                raise ValueError("archive ends inside a record")
            part, self.held = self.held[:size], self.held[size:]
            size -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode(errors="replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if k}


def _normaliser(folder: str):
    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                source_store, path = _store(archive)
                name = f"{base}/{uuid.uuid4().hex}.warc.gz"
                rows, at = [], 0
                with source_store.open_input_stream(path, compression=None) as stream, store.open_output_stream(name, compression=None) as out, \
                        store.open_output_stream(f"{name}.index", compression=None) as side:
                    source = _Source(_inflated(stream))
                    while (head := source.head()) is not None:
                        known = fields(head)
                        pack, begin = zlib.compressobj(6, zlib.DEFLATED, 31), at
                        pieces = [pack.compress(head)]
                        for part in source.take(int(known["content-length"]) + len(END)):
                            pieces.append(pack.compress(part))
                            if len(pieces) > 64:
                                at += out.write(b"".join(pieces)) or sum(map(len, pieces))
                                pieces = []
                        pieces.append(pack.flush())
                        last = b"".join(pieces)
                        out.write(last)
                        at += len(last)
                        rows.append((begin, at - begin))
                        side.write(f"{begin}\t{at - begin}\t{known.get('warc-record-id', '')}\t{known.get('warc-type', '')}\n".encode())
                place = f"{folder}/{name.rpartition('/')[2]}"
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.string()), pa.array([len(rows)], pa.int64())], ["archive", "records"])

    return run


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite whole-file gzip archives with one gzip member per record; ``(archive, records)`` of the new files.

    Each file is inflated once, front to back, in bounded memory whatever its or its records' size; records
    keep their bytes.  Beside each new file stands ``<file>.index``: offset, length, record id and type of every member.
    Files of several members are accepted.  An archive cut short raises ValueError.
    """
    listed = cut_lineage(archives.select("archive"))
    spread = listed.repartition(max(1, listed.count()))
    return written(mapped(spread, _normaliser(folder), "archive string, records long"), "normalised")


def _reader(batches):
    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            store, path = _store(archive)
            with store.open_input_stream(f"{path}.index", compression=None) as side:
                index = [line.split("\t")[:2] for line in side.read().decode().splitlines()]
            with store.open_input_file(path) as file:
                rows, held = [], 0
                for offset, length in index:
                    file.seek(int(offset))
                    raw = zlib.decompress(file.read(int(length)), 31)
                    head, _, block = raw.partition(END)
                    known = fields(head)
                    http, _, payload = block[:int(known["content-length"])].partition(END)
                    rows.append((known.get("warc-record-id", "")[1:-1], known["warc-type"], known.get("warc-target-uri"),
                                 known.get("warc-payload-digest", "").partition(":")[2], known.get("warc-refers-to", "")[1:-1] or None,
                                 int(fields(http).get("content-length", -1)), payload if known["warc-type"] == "response" else None))
                    held += len(raw)
                    if held > CHUNK:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)


def _rows(rows) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    names = ["record_id", "type", "uri", "digest", "refers_to", "http_length", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archives(archives: DataFrame) -> DataFrame:
    """``(record_id, type, uri, digest, refers_to, http_length, payload)`` of every record, member by member through the index."""
    listed = cut_lineage(archives.select("archive"))
    return mapped(listed.repartition(max(1, listed.count())), _reader, RECORDS)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least: int = LEAST_SHARED) -> DataFrame:
    """Records for pages: of equal payloads of at least ``least`` bytes the smallest id is a response, others revisit it.

    A null html is an empty payload.  A null id revisits when a page with an id holds the same payload, else it is
    a response.  Rows that repeat the smallest id are all responses.  Further columns are ignored.
    """
    base = given(pages, id=id_col, uri=url_col, text=html_col).select("id", F.col("uri").cast("string").alias("uri"), text_or_empty().alias("text")) \
        .withColumn("digest", F.sha2("text", 256))
    shared = base.filter(F.octet_length("text") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")) \
        .filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    shared = cut_lineage(shared)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")))
    return base.join(shared, "digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("kind"), name.alias("record_id"), "uri", "digest",
        F.when(revisit, F.concat(F.lit("urn:x-page:"), F.col("first").cast("string"))).alias("refers"), "text")


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write pages as WARC, normalise the archives, read them back:
    ``(id_col, payload_bytes, payload_digest, record_type, refers_to)`` of every page.

    A response's length and digest are those of the payload read back; a revisit's stand in its record.
    """
    folder = folder or scratch_dir(pages.sparkSession, "warc")
    whole = write_archives(page_records(pages, id_col, url_col, html_col), f"{folder}/whole")
    records = read_archives(normalise_archives(whole, f"{folder}/members"))
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS bigint)")
    return records.select(
        number("record_id").alias(id_col),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("http_length")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
