"""The operators of this subpackage on the given tables, next to the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return deco


LINKS = """
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, m) AS (SELECT DISTINCT a, a FROM ways UNION SELECT w.b, r.m FROM reach r JOIN ways w ON w.a = r.id AND r.m < w.b),
comp AS (SELECT id, min(m) AS component_id FROM reach GROUP BY id)
"""


@query(r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
""" + LINKS + """
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN comp c ON c.id = d.doc_id
""")
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), num=85, den=100)


@query("""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), all_hashes=True)


@query("""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
          AND list_cosine_similarity(x.e, y.e) >= 0.95),
""" + LINKS + """,
degrees AS (SELECT a AS id, count(*) AS n FROM ways GROUP BY a)
SELECT d.vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, d.vec_id) AS component_id, coalesce(component_id, d.vec_id) = d.vec_id AS kept
FROM embeddings d LEFT JOIN degrees g ON g.id = d.vec_id LEFT JOIN comp c ON c.id = d.vec_id
""")
def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


#: The key of the surrogates.  A secret of the deployment; this one serves the registered query.
SURROGATE_KEY = "surrogate-key-1"


@query()
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import surrogate_text

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogate_text(docs, SURROGATE_KEY, count_col="n_entities")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .packing import pieces, sequences

    packed = sequences(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces(packed).select(F.col("doc").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
                                 F.col("sequence").alias("sequence_id"), "offset")


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .archives import archived_pages

    return archived_pages(table(spark, sf_dir, "pages"))


@query("""
WITH RECURSIVE rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size,
         substr((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 14))::BIGINT)::BIT::VARCHAR, 9) AS bits FROM documents),
level(depth, shard, b, n) AS (
  SELECT 0, '', sum(size), count(*) FROM rows
  UNION ALL
  SELECT depth, shard, sum(size), count(*) FROM (
    SELECT l.depth + 1 AS depth, substr(r.bits, 1, l.depth + 1) AS shard, r.size
    FROM level l JOIN rows r ON substr(r.bits, 1, l.depth) = l.shard WHERE l.b > 67108864 AND l.depth < 56) GROUP BY ALL)
SELECT doc_id, size, shard, depth, b AS shard_bytes, n AS shard_rows
FROM rows JOIN level ON b <= 67108864 AND substr(bits, 1, depth) = shard
""")
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(table(spark, sf_dir, "documents"), max_bytes=64 << 20)


def _license_sql() -> str:
    from .licenses import template_values

    return rf"""
WITH t(license, text) AS (VALUES {template_values()}),
tw AS (SELECT license, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM t),
ts AS (SELECT DISTINCT license, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM tw),
tn AS (SELECT license, count(*) AS shingles FROM ts GROUP BY license),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
ds AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS k, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
       FROM dw WHERE len(w) >= 5)
SELECT doc_id, license, count(DISTINCT s) AS matched, shingles, count(DISTINCT s)::DOUBLE / shingles AS containment,
       min(k) AS first_word, max(k) + 4 AS last_word
FROM ds JOIN ts USING (s) JOIN tn USING (license) GROUP BY doc_id, license, shingles HAVING count(DISTINCT s) >= 0.8 * shingles
"""


@query(_license_sql())
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .quality import held_out, learn, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query()
def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def _merkle_sql() -> str:
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    leaf = "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)), lambda c, b: {step}), 4294967295)"

    def up(name, start):
        return f"""{name}(k, lvl, idx, n, h) AS ({start} UNION ALL
  SELECT k, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY k, lvl, n, idx // 3)"""

    def fold(name, nodes, start):
        return f"""{name}(r, k, lvl, idx, h, sib) AS ({start} UNION ALL
  SELECT f.r, f.k, f.lvl + 1, f.idx // 3, sha256(string_agg(CASE WHEN s.idx = f.idx THEN f.h ELSE s.h END, '' ORDER BY s.idx)),
         f.sib || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> f.idx), '')
  FROM {name} f JOIN {nodes} s ON s.k = f.k AND s.lvl = f.lvl AND s.idx // 3 = f.idx // 3 AND s.n > 1 GROUP BY f.r, f.k, f.lvl, f.idx, f.h, f.sib)"""

    return f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('g' || source, '') AS k, {leaf.format("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN {leaf.format("replace(text, chr(10), '')")} END AS other FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM rows),
{up("low", "SELECT k, 0, idx, n, leaf FROM placed")},
sub AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
{up("high", "SELECT '', 0, idx, n, h FROM sub")},
{fold("one", "low", "SELECT r, k, 0, idx, coalesce(other, leaf), '' FROM placed")},
tops AS (SELECT r, max_by(k, lvl) AS k, max_by(h, lvl) AS h, max_by(sib, lvl) AS sib FROM one GROUP BY r),
{fold("two", "high", "SELECT r, '', 0, sub.idx, tops.h, sib FROM tops JOIN sub USING (k)")},
ends AS (SELECT r, max_by(h, lvl) AS h, max_by(sib, lvl) AS sib FROM two GROUP BY r)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(sib) AS proof_sha256, ends.h AS folded_root, ends.h = top.h AS verified
FROM placed JOIN sub USING (k) JOIN ends USING (r), (SELECT h FROM high WHERE n = 1) top
"""


@query(_merkle_sql())
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(table(spark, sf_dir, "documents")).drop("copied")


@query()
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import digests, periodic_runs

    found = periodic_runs(table(spark, sf_dir, "documents"), plant=True)
    return found.select("doc_id", *digests(found))


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
