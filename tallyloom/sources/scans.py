"""Readers: everything is read as text columns first, then typed in one select; rows that do not
parse can be kept aside instead of vanishing."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import timecols as tc

# Accepted header names and the column each stands for.
EVENT_ALIASES = {"TimeGenerated": "timestamp", "Time Generated": "timestamp", "Time": "timestamp",
                 "EventType": "event_type", "Event Type": "event_type", "EventID": "event_id", "Event ID": "event_id",
                 "ComputerName": "computer_name", "Computer Name": "computer_name", "Computer": "computer_name"}
COMMIT_ALIASES = {"commit_time": "timestamp", "commit_timestamp": "timestamp", "time": "timestamp",
                  "repository": "repo_name", "repo": "repo_name", "commit_message": "message", "msg": "message",
                  "wbso_eligible": "is_wbso", "wbso": "is_wbso"}


def first_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(file, line)``: the first line of every text file of a folder."""
    options = {"pathGlobFilter": glob} if glob else {}
    lines = spark.read.text(path, **options).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.filter("block = 0").groupBy("file").agg(F.first("value").alias("line"))


def csv_groups(spark: SparkSession, path: str, glob: str | None = None) -> list[tuple[list[str], DataFrame]]:
    """Header names and rows (all text) of the CSV files of a folder, one pair for each distinct header.

    Files of different headers are never read together, so columns cannot shift; quoted line breaks,
    commas and quotes stay inside their field.  The driver holds file names and header lines, no more
    than the file listing that any read makes.
    """
    by_head: dict[str, list[str]] = {}
    for file, line in first_lines(spark, path, glob).collect():
        by_head.setdefault(line, []).append(file)
    out = []
    for head, files in sorted(by_head.items()):
        names: list[str] = []
        for raw in next(csv.reader([head.lstrip("\ufeff")])):
            name, n = raw.strip().strip('"'), 1
            while (name if n == 1 else f"{name}_{n}") in names:
                n += 1
            names.append(name if n == 1 else f"{name}_{n}")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        out.append((names, spark.read.schema(schema).csv(sorted(files), header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")))
    return out


def scan_csv_alias(spark: SparkSession, path: str, aliases: dict[str, str] = EVENT_ALIASES,
                   required: tuple[str, ...] = ("timestamp", "event_type", "event_id", "computer_name")) -> DataFrame:
    """All CSV files of a folder under canonical names.  Files without a canonical column are
    skipped; rows whose timestamp does not parse are dropped; no usable file is an error."""
    out = None
    for names, df in csv_groups(spark, path, "*.csv"):
        known = [aliases.get(n, n) for n in names]
        if not set(required) <= set(known):
            continue
        first = {k: n for k, n in reversed(list(zip(known, names)))}
        df = df.select(*[F.col(f"`{n}`").alias(k) for k, n in first.items()])
        df = df.withColumn("timestamp", tc.parse_stamp("timestamp")).filter("timestamp is not null")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no usable csv in {path}")
    return out


def fuzzy_columns(names: list[str], wanted: list[str]) -> dict[str, str]:
    """First header that contains each wanted name, byte-order marks and case ignored."""
    got = {}
    for w in wanted:
        for n in names:
            if w.lower() in n.replace("﻿", "").strip().strip('"').lower():
                got[w] = n
                break
    return got


def scan_csv_bom(spark: SparkSession, path: str, wanted: list[str] = ("DateTime", "EventId", "EventType", "Message", "RecordId")) -> DataFrame:
    """The wanted columns of every file by its own header; a file without one of them has nulls there."""
    out = None
    for names, df in csv_groups(spark, path):
        got = fuzzy_columns(names, list(wanted))
        df = df.select(*[(F.col(f"`{got[w]}`") if w in got else F.lit(None).cast("string")).alias(w) for w in wanted])
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise FileNotFoundError(f"no csv in {path}")
    return out


def commit_lines(df: DataFrame, line: str, file: Column, sep: str = "|") -> DataFrame:
    """datetime|epoch|subject|author|hash; lines without five non-blank fields or a readable time go."""
    if sep == ",":
        p = F.from_csv(F.col(line), "a string, b string, c string, d string, e string, more string", {"escape": '"'})
        d = df.withColumn("__c", p).filter("__c.more is null").withColumn("__p", F.array(*[F.coalesce(f"__c.{k}", F.lit("")) for k in "abcde"]))
    else:
        d = df.withColumn("__p", F.split(F.col(line), "\\" + sep, -1)).filter(F.size("__p") == 5)
    d = d.filter(F.forall("__p", lambda x: F.trim(x) != ""))
    names = ["datetime", "epoch", "message", "author", "hash"]
    d = d.select(tx.stem(file).alias("repo_name"), *[F.trim(F.col("__p")[i]).alias(n) for i, n in enumerate(names)])
    return d.withColumn("timestamp", tc.parse_stamp("datetime")).filter("timestamp is not null")


def scan_csv_pipe(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("f")).filter("not startswith(value, 'datetime|')")
    return commit_lines(raw, "value", F.col("f"))


def scan_csv_delim_fallback(spark: SparkSession, path: str) -> DataFrame:
    """Pipe or comma, decided for each file by its first line (five fields at pipes, or else commas);
    both kinds end in one table.  A pipe or comma inside a subject decides nothing."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    kind = first_lines(spark, path).select("file", (F.size(F.split("line", r"\|", -1)) == 5).alias("pipe"))
    j = raw.join(kind, "file").filter("not rlike(value, '^\ufeff?datetime[|,]')")
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    return commit_lines(j.filter("pipe"), "value", name).unionByName(commit_lines(j.filter("not pipe"), "value", name, ","))


def git_log_lines(df: DataFrame, line: str) -> DataFrame:
    """datetime|epoch|subject|author|hash split at most four times; other lines are dropped."""
    p = F.split(F.col(line), "\\|", 5)
    return df.withColumn("__p", p).filter(F.size("__p") == 5).select(
        *[F.col("__p")[i].alias(n) for i, n in enumerate(["datetime", "epoch", "subject", "author", "hash"])])


def ingest_from_git_log(spark: SparkSession, path: str) -> DataFrame:
    return git_log_lines(spark.read.text(path), "value")


def _one_text_a_file(spark: SparkSession) -> DataFrameReader:
    """Reader of files that hold one JSON text each.  It takes a file as one line, up to a character that JSON does not allow:
    with ``multiLine`` Spark goes back to the file for every number or flag that becomes a string."""
    return spark.read.option("lineSep", "\x1e")


def scan_json_records(spark: SparkSession, path: str, aliases: dict[str, str] = COMMIT_ALIASES,
                      required: tuple[str, ...] = ("timestamp", "repo_name", "author", "message", "hash"),
                      flag: str = "is_wbso") -> DataFrame:
    """JSON arrays of records under canonical names; a file that is no list is an error."""
    whole = spark.read.text(path, wholetext=True)
    if not whole.filter("not rlike(value, '^\\\\s*\\\\[')").isEmpty():
        raise ValueError(f"{path}: expected a list of records")
    return commit_records(_one_text_a_file(spark).option("primitivesAsString", True).json(path), aliases, required, flag)


def commit_records(df: DataFrame, aliases: dict[str, str] = COMMIT_ALIASES,
                   required: tuple[str, ...] = ("timestamp", "repo_name", "author", "message", "hash"),
                   flag: str = "is_wbso") -> DataFrame:
    """Records under canonical names with a typed time and flag."""
    df = df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns and v not in df.columns})
    gone = [c for c in required if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {gone}")
    marked = F.lower(F.col(flag).cast("string")) if flag in df.columns else F.lit("false")
    return df.withColumn("timestamp", tc.parse_stamp("timestamp")).withColumn("is_eligible", marked.isin("true", "1", "yes"))


# Keys that may wrap a list of sessions.
SESSION_WRAPPERS = ["work_sessions", "sessions", "synthetic_sessions"]


def polymorphic_records(df: DataFrame, text: str, record: str) -> DataFrame:
    """One JSON text per row: a list, an object wrapping a list, or one bare object.
    ``record`` is the DDL of a record.  Texts that hold none are left to ``polymorphic_rejects``."""
    arr = f"array<struct<{record}>>"
    t = F.trim(F.col(text))
    wrapped = F.coalesce(*[F.from_json(F.get_json_object(t, f"$.{k}"), arr) for k in SESSION_WRAPPERS])
    rows = F.when(F.startswith(t, F.lit("[")), F.from_json(t, arr)).otherwise(
        F.coalesce(wrapped, F.array(F.from_json(t, f"struct<{record}>"))))
    return df.select(F.explode(rows).alias("r")).filter("r is not null").select("r.*")


def polymorphic_rejects(df: DataFrame, text: str) -> DataFrame:
    """The texts that are no JSON list and no JSON object, as they stand."""
    t = F.trim(F.col(text))
    kind = F.when(F.startswith(t, F.lit("[")), F.json_array_length(t).isNotNull()).otherwise(F.json_object_keys(t).isNotNull())
    return df.filter(~F.coalesce(kind, F.lit(False))).select(F.col(text).alias("_rejected"))


def scan_json_polymorphic(spark: SparkSession, path: str, record: str, one_per: str = "file") -> DataFrame:
    """Files of one JSON text each, or with ``one_per="line"`` of one on each line."""
    return polymorphic_records(spark.read.text(path, wholetext=one_per == "file"), "value", record)


def eval_items(df: DataFrame) -> DataFrame:
    """Question and non-empty ground-truth contexts, else the item is skipped."""
    return df.filter((F.length(F.trim("question")) > 0) & (F.size("ground_truth_contexts") > 0))


def scan_eval_dataset(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    if not whole.filter("not rlike(value, '^\\\\s*\\\\[')").isEmpty():
        raise ValueError(f"{path}: expected a JSON array")
    schema = "question string, ground_truth_contexts array<string>, expected_answer string"
    return eval_items(_one_text_a_file(spark).schema(schema).json(path))


TEXT_KINDS = ["md", "txt", "html", "htm"]


def scan_text_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """.md .txt .html .htm files as text with their headings; broken bytes become U+FFFD."""
    return file_texts(spark.read.format("binaryFile").options(**options).load(path))


def file_texts(files: DataFrame) -> DataFrame:
    """Text and headings of binary file rows ``(path, length, content)`` of the accepted kinds."""
    b = files.filter(tx.extension("path").isin(*TEXT_KINDS))
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    d = b.select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash"), tx.extension("path").alias("file_type"), raw.alias("raw"))
    html = tx.html_text(F.when(F.col("file_type").isin("html", "htm"), F.col("raw")))
    d = d.withColumn("h", html)
    is_html = F.col("file_type").isin("html", "htm")
    heads = F.when(is_html, F.col("h.headings")).when(F.col("file_type") == "md", tx.markdown_headings("raw")).otherwise(F.array().cast("array<string>"))
    return d.withColumn("text", F.when(is_html, F.col("h.text")).otherwise(F.col("raw"))).withColumn("section_headings", heads).drop("h", "raw")


# Admitted extensions, media types and the size limit.
ADMITTED = ["pdf", "docx", "md", "txt", "html", "htm"]
ADMITTED_MEDIA = ["application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
                  "text/plain", "text/markdown", "text/html", "text/csv", "application/json"]
MAX_BYTES = 100 * 1024 * 1024


def admission(name: Column, size: Column, media: Column | None = None) -> Column:
    """Why a file is refused, or null.  ``media`` switches on the upload rules."""
    out = F.when(~tx.extension(name).isin(*ADMITTED), "extension").when(size > MAX_BYTES, "too_large")
    if media is not None:
        out = out.when(size <= 0, "empty").when(~media.isin(*ADMITTED_MEDIA), "media_type") \
            .when(F.contains(name, F.lit("..")) | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")), "unsafe_name")
    return out


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes only; file contents are not read."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def scan_chunks(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks with an index; text falls back to the metadata.  ``limit=None`` reads all."""
    d = chunks.filter("chunk_index >= 0").withColumn(
        "text", F.coalesce("text", F.try_element_at("metadata", F.lit("text")), F.lit("")))
    return d.limit(limit) if limit else d


def scan_rel_store(spark: SparkSession, url: str | None, tables: list[str], folder: str | None = None, **options) -> dict[str, DataFrame]:
    """Relational tables over JDBC, or the same tables as parquet under ``folder``."""
    if url:
        return {t: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for t in tables}
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables}


def freshness(files: DataFrame, path: str, modified: str, today: str) -> DataFrame:
    """Latest date in file names ``*_YYYYMMDD.csv``, latest change, and whether a refresh is due."""
    d = F.try_to_date(F.regexp_extract(F.col(path), r"_(\d{8})\.csv$", 1), "yyyyMMdd") if hasattr(F, "try_to_date") else \
        F.to_date(F.try_to_timestamp(F.regexp_extract(F.col(path), r"_(\d{8})\.csv$", 1), F.lit("yyyyMMdd")))
    g = files.agg(F.max(d).alias("latest_date"), F.max(modified).alias("latest_change"))
    return g.withColumn("refresh_due", F.coalesce(F.col("latest_date") < F.date_sub(F.lit(today).cast("date"), 1), F.lit(True)))


def calendar_rows(df: DataFrame) -> DataFrame:
    """Calendar export rows: title, start, end (blank time = midnight) and whole minutes; rows
    without readable dates are skipped."""
    cols = {c.lower(): c for c in df.columns}
    title = F.col(f"`{cols.get('subject', cols.get('summary'))}`")

    def stamp(side):
        time = F.coalesce(F.nullif(F.trim(F.col(f"`{cols[side + ' time']}`")), F.lit("")), F.lit("12:00 AM"))
        return F.try_to_timestamp(F.concat_ws(" ", F.trim(F.col(f"`{cols[side + ' date']}`")), time), F.lit("M/d/yyyy h:mm a")).cast("timestamp_ntz")

    d = df.withColumn("title", title).withColumn("start", stamp("start")).withColumn("end", stamp("end"))
    d = d.filter("start is not null and end is not null")
    return d.withColumn("minutes", tc.minutes_between("start", "end"))


def scan_calendar_csv(spark: SparkSession, path: str) -> DataFrame:
    return calendar_rows(spark.read.csv(path, header=True))
