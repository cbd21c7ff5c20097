"""A store of chunk records with their vectors: append, replace, delete, scan, search and count, by document."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another commit came first; nothing of this one is visible."""


class ChunkStore:
    """Parquet records of documents, dealt by a hash of the document to a fixed number of buckets.

    A commit writes new folders for the buckets it touches and then one small file, the next version of the bucket list,
    by a rename that fails if that version exists.  Until then readers see the former version, whole; a job that fails leaves
    folders that no version names (``vacuum`` deletes them).  There are as many folders as buckets and commits, never as
    many as documents.  A list has one entry for each bucket and append since the last rewrite of that bucket.

    ``doc`` names the document column.  Null documents share a bucket and can be scanned, but not named for deletion.
    """

    def __init__(self, spark: SparkSession, path: str, doc: str = "document_name", buckets: int = 256):
        self.spark, self.path, self.doc, self.buckets = spark, path.rstrip("/"), doc, buckets

    # -- versions --------------------------------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.path}/versions") if n.isdigit())

    def _load(self) -> tuple[int, dict]:
        """The newest version and its list: schema, bucket count, and the folders of each bucket."""
        found = self.versions()
        if not found:
            return 0, {"schema": None, "buckets": self.buckets, "folders": {}}
        fs, p = self._fs(f"{self.path}/versions/{found[-1]}")
        stream = fs.open(p)
        try:
            state = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if state["buckets"] != self.buckets:
            raise ValueError(f"{self.path}: the store has {state['buckets']} buckets")
        return found[-1], state

    def _commit(self, after: int, state: dict) -> int:
        fs, temporary = self._fs(f"{self.path}/.version-{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final = self._fs(f"{self.path}/versions/{after + 1}")[1]
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise Conflict(f"{self.path}: version {after + 1} is there already")
        return after + 1

    # -- rows ------------------------------------------------------------------------------------
    def _bucket(self, name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict, buckets: set[int] | None = None) -> DataFrame | None:
        if state["schema"] is None:
            return None
        paths = [f"{self.path}/data/{f}/bucket={b}" for b, folders in state["folders"].items() if buckets is None or int(b) in buckets for f in folders]
        schema = T.StructType.fromJson(state["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame) -> tuple[str, set[int]]:
        """Rows under a new folder, one folder a bucket, and which buckets came into being."""
        folder = uuid.uuid4().hex
        out = rows.withColumn("bucket", self._bucket(F.col(self.doc)))
        out.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        return folder, {int(n[7:]) for n in self._names(f"{self.path}/data/{folder}") if n.startswith("bucket=")}

    def _touched(self, names: DataFrame) -> set[int]:
        return {r[0] for r in names.select(self._bucket(F.col(self.doc)).alias("b")).distinct().collect()}  # at most ``buckets`` numbers

    def _shape(self, state: dict, rows: DataFrame) -> DataFrame:
        if state["schema"] is None:
            state["schema"] = rows.schema.jsonValue()
            return rows
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromJson(state["schema"]).fields])

    def append(self, rows: DataFrame) -> int:
        """Add records; the new version."""
        version, state = self._load()
        folder, came = self._write(self._shape(state, rows))
        for b in came:
            state["folders"].setdefault(str(b), []).append(folder)
        return self._commit(version, state)

    def _rewritten(self, version: int, state: dict, buckets: set[int], rows: DataFrame | None) -> int:
        """The touched buckets hold ``rows`` and nothing else."""
        folder, came = self._write(rows) if rows is not None and buckets else ("", set())
        for b in buckets:
            state["folders"].pop(str(b), None)
            if b in came:
                state["folders"][str(b)] = [folder]
        return self._commit(version, state)

    def replace(self, rows: DataFrame) -> int:
        """Each document among ``rows`` gets these records for its earlier ones; other documents stay.  Only their buckets are written."""
        version, state = self._load()
        rows = self._shape(state, rows)
        names = rows.select(self.doc).distinct()
        buckets = self._touched(names)
        stay = self._read(state, buckets).join(names, self.doc, "left_anti").select(*rows.columns)
        return self._rewritten(version, state, buckets, stay.unionByName(rows))

    def delete(self, names: DataFrame) -> dict[str, int]:
        """Remove the named documents; how many records and documents went."""
        version, state = self._load()
        if state["schema"] is None:
            return {"records": 0, "documents": 0}
        names = names.select(self.doc).filter(F.col(self.doc).isNotNull()).distinct()
        buckets = self._touched(names)
        old = self._read(state, buckets)
        gone = old.join(names, self.doc, "left_semi").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(self.doc).alias("d")).first()
        if gone.n:
            self._rewritten(version, state, buckets, old.join(names, self.doc, "left_anti").select(*old.columns))
        return {"records": gone.n, "documents": gone.d}

    def compact(self, most: int = 8) -> int | None:
        """Rewrite the buckets of more than ``most`` folders; the new version, None if there are none."""
        version, state = self._load()
        buckets = {int(b) for b, folders in state["folders"].items() if len(folders) > most}
        return self._rewritten(version, state, buckets, self._read(state, buckets)) if buckets else None

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions but the last ``keep``, and folders that no kept version names; how many folders went.  Not while a commit runs."""
        found, named = self.versions(), set()
        for v in found[-keep:]:
            fs, p = self._fs(f"{self.path}/versions/{v}")
            stream = fs.open(p)
            state = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            named |= {f for folders in state["folders"].values() for f in folders}
        for v in found[:-keep]:
            fs, p = self._fs(f"{self.path}/versions/{v}")
            fs.delete(p, False)
        idle = [n for n in self._names(f"{self.path}/data") if n not in named]
        for n in idle:
            fs, p = self._fs(f"{self.path}/data/{n}")
            fs.delete(p, True)
        return len(idle)

    # -- reading ---------------------------------------------------------------------------------
    def scan(self, documents: list[str] | None = None) -> DataFrame:
        """All records, or those of some documents, of which only the buckets are read."""
        _, state = self._load()
        if state["schema"] is None:
            raise ValueError(f"{self.path}: empty store")
        if documents is None:
            return self._read(state)
        kind = T.StructType.fromJson(state["schema"])[self.doc].dataType
        names = self.spark.createDataFrame([(d,) for d in documents], T.StructType([T.StructField(self.doc, kind)]))
        return self._read(state, self._touched(names)).filter(F.col(self.doc).isin(documents))

    def count(self) -> int:
        """Records, from the files' own counts."""
        _, state = self._load()
        return 0 if state["schema"] is None else self._read(state).count()

    def search(self, queries: DataFrame, query_id: str, query_vector: str, rid: str, vector: str, k: int) -> DataFrame:
        """The ``k`` nearest records of each query by cosine: ``(query, id, score, rank)``."""
        from ..operators.retrieval import dense_topk

        return dense_topk(self.scan(), rid, vector, queries, query_id, query_vector, k)
