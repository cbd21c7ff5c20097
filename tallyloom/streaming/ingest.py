"""Files to chunks, again and again: what was added, changed or removed since the last run, in bounded batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import cut_lineage, first_per
from ..sources.scans import TEXT_KINDS, file_texts

DOCS = "path string, length long, modified timestamp, hash string, gone boolean"
MOST_NAMES = 10_000  # files of a batch whose names the driver holds
CHANGES = "path string, length long, modified timestamp, gone boolean"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _fs(spark, path)
    target = _fs(spark, to)[1]
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"{path} could not become {to}")


class FileIngest:
    """Chunks of the text files below ``folder``, kept under ``out`` and brought up to date by ``sync``.

    A run lists the folder (no contents are read), compares paths, sizes and times with the documents it knows and writes
    the differences to a journal, ``per_batch`` files in each journal file.  A stream reads the journal, one such file a
    micro-batch (small files may lie together beyond that number, up to ``batch_bytes`` of contents on average and ``MOST_NAMES``
    of them, as each batch has a cost of its own): it reads those files, hashes them, and writes chunks and document rows to folders named after the batch.  A batch
    that runs again overwrites its own folders, so nothing doubles.  A document counts with its last batch: a changed one
    replaces its chunks, a removed one loses them; one whose bytes are as before writes no chunks.

    Every ``compact_every`` batches the current state is written as a new base.  A base counts once both its tables are whole, and
    readers take the newest, so a failed compaction leaves the old one in force; what two bases cover is deleted.  Reading
    back thus takes a base and at most about ``2 * compact_every`` batches, however long the history.

    ``to_chunks`` gets ``(path, file_type, text, section_headings, hash)`` rows and returns chunk rows with ``path`` and ``hash``, no
    row for an empty document.  Files that vanish between listing and reading count as removed at the next run.
    """

    def __init__(self, spark: SparkSession, folder: str, out: str, to_chunks: Callable[[DataFrame], DataFrame], per_batch: int = 1000, compact_every: int = 20,
                 batch_bytes: int = 0):
        self.spark, self.folder, self.out, self.to_chunks = spark, folder, out, to_chunks
        self.per_batch, self.compact_every, self.batch_bytes = per_batch, compact_every, batch_bytes

    # -- what is stored ------------------------------------------------------------------------
    def _base(self, before: int | None = None) -> int:
        """The newest whole base, -1 without one; ``before`` names one that is not to count."""
        whole = [int(n) for n in children(self.spark, f"{self.out}/base") if n.isdigit()
                 and all(exists(self.spark, f"{self.out}/base/{n}/{t}/_SUCCESS") for t in ("docs", "chunks"))]
        return max((n for n in whole if before is None or n < before), default=-1)

    def _rows(self, kind: str, schema: str | None) -> DataFrame | None:
        """The base and the later batches of ``docs`` or ``chunks``, with the batch of each row."""
        base, parts = self._base(), []
        if base >= 0:
            read = self.spark.read if schema is None else self.spark.read.schema(schema + ", batch long")
            parts.append(read.parquet(f"{self.out}/base/{base}/{kind}"))
        late = sorted(int(n[6:]) for n in children(self.spark, f"{self.out}/delta/{kind}") if n.startswith("batch=") and int(n[6:]) > base)
        if late:
            paths = [f"{self.out}/delta/{kind}/batch={n}" for n in late]
            read = self.spark.read if schema is None else self.spark.read.schema(schema + ", batch long")
            parts.append(read.option("basePath", f"{self.out}/delta/{kind}").parquet(*paths).withColumn("batch", F.col("batch").cast("long")))
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def documents(self) -> DataFrame:
        """The last known row of each path, removed ones (``gone``) included."""
        rows = self._rows("docs", DOCS)
        if rows is None:
            return self.spark.createDataFrame([], DOCS + ", batch long")
        return first_per(rows, ["path"], [F.desc("batch")])

    def chunks(self) -> DataFrame | None:
        """Chunks of the documents that are there, each from the batch that last wrote it; None before the first document."""
        rows = self._rows("chunks", None)
        if rows is None:
            return None
        # an unchanged document keeps the chunks that its hash names: those of the last batch that wrote them
        last = self.documents().filter("NOT gone").select("path", "hash")
        mine = rows.join(last, ["path", "hash"])
        newest = mine.groupBy("path").agg(F.max("batch").alias("batch"))
        return mine.join(newest, ["path", "batch"]).drop("batch")

    # -- a run -----------------------------------------------------------------------------------
    def changes(self) -> DataFrame:
        """Paths that are new, have another size or time, or are gone."""
        kinds = "*.{" + ",".join(TEXT_KINDS) + "}"
        now = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", kinds).load(self.folder) \
            .select("path", F.col("length").alias("now_length"), F.col("modificationTime").alias("now_modified"))
        known = self.documents().filter("NOT gone").select("path", "length", "modified")
        both = now.join(known, "path", "full")
        same = F.col("length").eqNullSafe(F.col("now_length")) & F.col("modified").eqNullSafe(F.col("now_modified"))
        return both.filter(~same).select("path", F.col("now_length").alias("length"), F.col("now_modified").alias("modified"), F.col("now_length").isNull().alias("gone"))

    def _step(self, batch: DataFrame, batch_id: int) -> None:
        wanted = first_per(batch, ["path"], [F.desc("modified"), "gone"])
        paths = [r.path for r in wanted.filter("NOT gone").select("path").collect()]  # at most per_batch names
        gone = wanted.filter("gone").withColumn("hash", F.lit(None).cast("string"))
        docs = gone
        if paths:
            files = self.spark.read.format("binaryFile").option("ignoreMissingFiles", True).load([p.replace("\\", "\\\\") for p in paths])
            texts = file_texts(files).select("path", "file_type", "text", "section_headings", F.col("file_hash").alias("hash"))
            known = self.documents().filter(F.col("batch") < batch_id).filter("NOT gone").select("path", "hash")
            self.to_chunks(texts.join(known, ["path", "hash"], "left_anti")).write.mode("overwrite").parquet(f"{self.out}/delta/chunks/batch={batch_id}")
            read = files.select("path", F.sha2("content", 256).alias("hash"))
            docs = docs.unionByName(wanted.filter("NOT gone").join(read, "path"))
        # document rows come last: a batch without them has not happened
        docs.select("path", "length", "modified", "hash", "gone").write.mode("overwrite").parquet(f"{self.out}/delta/docs/batch={batch_id}")

    def sync(self) -> DataFrame | None:
        """Bring the chunks up to date with the folder and return them."""
        found = cut_lineage(self.changes())
        n, size = found.agg(F.count(F.lit(1)), F.sum("length")).first()
        many = min(MOST_NAMES, self.batch_bytes * n // max(size or 0, 1))
        found.coalesce(max(1, n // 1_000_000)).write.mode("append").option("maxRecordsPerFile", max(self.per_batch, many)).parquet(f"{self.out}/journal")
        journal = self.spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{self.out}/journal")
        q = journal.writeStream.foreachBatch(self._step).option("checkpointLocation", f"{self.out}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
        self.compact()
        return self.chunks()

    def compact(self, now: bool = False) -> None:
        """Write a new base when enough batches have come since the last one."""
        base = self._base()
        done = [int(n[6:]) for n in children(self.spark, f"{self.out}/delta/docs") if n.startswith("batch=")]
        top = max(done, default=-1)
        if top - base < (1 if now else self.compact_every):
            return
        chunks = self.chunks()
        to = f"{self.out}/base/{top}"
        if chunks is not None:
            chunks.withColumn("batch", F.lit(top).cast("long")).write.mode("overwrite").parquet(f"{to}/chunks")
            self.documents().filter("NOT gone").withColumn("batch", F.lit(top).cast("long")).write.mode("overwrite").parquet(f"{to}/docs")
        # readers of the last base may still be at work: only what the base before it covers goes
        for n in (n for n in done if n <= base):
            for kind in ("chunks", "docs"):
                remove(self.spark, f"{self.out}/delta/{kind}/batch={n}")
        for n in children(self.spark, f"{self.out}/base"):
            if n.isdigit() and int(n) < base:
                remove(self.spark, f"{self.out}/base/{n}")
