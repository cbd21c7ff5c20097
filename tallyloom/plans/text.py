"""Text cleaning, chunking and scalar function queries."""

from pyspark.sql import functions as F

from ..functions import keywords as kw
from ..functions import text as tx
from ..functions import timecols as tc
from ..operators import chunks as C
from ..scale import first_per
from . import fixtures as fx
from .fixtures import SHIFTED_SQL, hrs, txt
from ..scale import spread
from .registry import query

SP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CTL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def collapse_sql(x):
    return f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"


def clean_sql(x):
    return f"regexp_replace(regexp_replace({collapse_sql(x)}, '{CTL}', '', 'g'), '[.!?]{{3,}}', '...', 'g')"


def count_sql(x, p):
    return f"len(regexp_extract_all({x}, '{p}'))"


def alnum_sql(x):
    return f"CASE WHEN length({x}) > 0 THEN {count_sql(x, '[a-zA-Z0-9]')} / length({x}) ELSE 0.0 END"


def useful_sql(x):
    return f"CASE WHEN length(trim({x})) >= 10 AND {alnum_sql(x)} >= 0.1 THEN {x} END"


def toks_sql(x):
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def norm_sql(x):
    return f"lower({collapse_sql(x)})"


@query("clean_text", f"SELECT doc_id, sha256({clean_sql('text')}) AS h, length({clean_sql('text')}) AS n FROM documents")
def _(t):
    c = spread(t.documents).select("doc_id", tx.clean_text("text").alias("c"))
    return c.select("doc_id", F.sha2("c", 256).alias("h"), F.length("c").alias("n"))


@query("clean_text_aggressive", f"""WITH a AS (SELECT doc_id, {collapse_sql("regexp_replace(" + clean_sql('text') + ", '[^\\x20-\\x7E\\n\\t]', '', 'g')")} AS c FROM documents)
 SELECT doc_id, sha256(c) AS h, length(c) AS n FROM a""")
def _(t):
    c = spread(t.documents).select("doc_id", tx.clean_text("text", aggressive=True).alias("c"))
    return c.select("doc_id", F.sha2("c", 256).alias("h"), F.length("c").alias("n"))


@query("clean_chunk", f"""WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT doc_id, {clean_sql('line')} AS c, line FROM a)
 SELECT doc_id, count(*) AS lines, count({useful_sql('c')}) AS kept, count(*) FILTER (length(regexp_replace(line, '^{SP}+|{SP}+$', '', 'g')) >= 10 AND {alnum_sql('line')} >= 0.1) AS raw_ok FROM b GROUP BY 1""")
def _(t):
    d = spread(t.documents).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    d = d.withColumn("c", tx.clean_text("line"))
    return d.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(tx.keep_if_useful(F.col("c"))).alias("kept"), F.count_if(tx.chunk_quality("line")).alias("raw_ok"))


@query("text_stats", f"""SELECT doc_id, length(text) AS length, len(list_filter(string_split({collapse_sql('text')}, ' '), lambda x: x <> '')) AS word_count, round({alnum_sql('text')}, 6) AS alphanumeric_ratio,
 round({count_sql('text', SP)} / length(text), 6) AS whitespace_ratio, round((length(text) - {count_sql('text', '[a-zA-Z0-9]')} - {count_sql('text', SP)}) / length(text), 6) AS special_char_ratio FROM documents""")
def _(t):
    s = spread(t.documents).select("doc_id", tx.text_stats("text").alias("s")).select("doc_id", "s.*")
    return s.select("doc_id", "length", "word_count", *[F.round(c, 6).alias(c) for c in ("alphanumeric_ratio", "whitespace_ratio", "special_char_ratio")])


HY = "regexp_replace(text, '[ ]', '-' || chr(10), 'g')"


@query("dehyphenate", f"SELECT doc_id, sha256({collapse_sql(f'''regexp_replace({HY}, '-\\n([\\p{{L}}\\p{{N}}_])', '\\1', 'g')''')}) AS h FROM documents")
def _(t):
    return spread(t.documents).select("doc_id", F.sha2(tx.dehyphenate(F.regexp_replace("text", "[ ]", "-\n")), 256).alias("h"))


@query("html_text")
def _(t):
    p = spread(t.pages).select("page_id", tx.html_text("html").alias("x"))
    return p.select("page_id", F.length("x.text").alias("n"), F.sha2("x.text", 256).alias("h"), F.size("x.headings").alias("headings"))


@query("html_strip_tags", f"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), '^{SP}+|{SP}+$', '', 'g')) AS h FROM pages""")
def _(t):
    return spread(t.pages).select("page_id", F.sha2(tx.strip_tags("html"), 256).alias("h"))


@query("headings", """WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS hs FROM pages)
 SELECT page_id, len(hs) AS n, array_to_string(list_transform(hs, lambda h: trim(regexp_replace(h, '<[^>]*>', '', 'g'))), '|') AS headings FROM a""")
def _(t):
    return spread(t.pages).select("page_id", tx.html_headings("html").alias("hs")).select("page_id", F.size("hs").alias("n"), F.array_join("hs", "|").alias("headings"))


@query("headings_markdown", """WITH a AS (SELECT doc_id, '# ' || replace(text, chr(10), chr(10) || '## ') AS md FROM documents)
 SELECT doc_id, len(regexp_extract_all(md, '(?m)^#{1,6}\\s+(.+)$', 1)) AS n, sha256(array_to_string(list_transform(regexp_extract_all(md, '(?m)^#{1,6}\\s+(.+)$', 1), lambda x: trim(x)), '|')) AS h FROM a""")
def _(t):
    md = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return spread(t.documents).select("doc_id", tx.markdown_headings(md).alias("hs")).select("doc_id", F.size("hs").alias("n"), F.sha2(F.array_join("hs", "|"), 256).alias("h"))


@query("tokenize", f"SELECT doc_id, len({toks_sql('text')}) AS n, sha256(array_to_string({toks_sql('text')}, ' ')) AS h FROM documents")
def _(t):
    return spread(t.documents).select("doc_id", tx.tokens("text").alias("x")).select("doc_id", F.size("x").alias("n"), F.sha2(F.array_join("x", " "), 256).alias("h"))


@query("normalize_match", f"SELECT doc_id, sha256({norm_sql('text')}) AS h FROM documents")
def _(t):
    return spread(t.documents).select("doc_id", F.sha2(tx.normalize_match("text"), 256).alias("h"))


@query("preview", "SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", tx.preview("text").alias("preview"))


@query("mime_from_ext", """WITH a AS (SELECT page_id, 'dir/' || page_id || CASE page_id % 5 WHEN 0 THEN '.html' WHEN 1 THEN '.PDF' WHEN 2 THEN '.md' WHEN 3 THEN '.bin' ELSE '' END AS p FROM pages)
 SELECT page_id, CAST(page_id AS VARCHAR) AS stem, CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/markdown' ELSE 'application/octet-stream' END AS mime FROM a""")
def _(t):
    k = F.col("page_id") % 5
    p = F.concat(F.lit("dir/"), F.col("page_id"), F.when(k == 0, ".html").when(k == 1, ".PDF").when(k == 2, ".md").when(k == 3, ".bin").otherwise(""))
    return spread(t.pages).select("page_id", tx.stem(p).alias("stem"), tx.media_type(p).alias("mime"))


TERMS = ["Then", "Rest", "tion", "Über", "eau", "zzzz"]


@query("glossary_find", "SELECT conv_id, turn, array_to_string(list_filter(['Then','Rest','tion','Über','eau','zzzz'], lambda w: contains(lower(text), lower(w))), ',') AS terms FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_join(tx.terms_in("text", TERMS), ",").alias("terms"))


@query("glossary_fix_word", """SELECT p_partkey, CASE lower(split_part(p_name, ' ', 2)) WHEN 'ring' THEN 'band' WHEN 'bolt' THEN 'screw' WHEN 'gizmo' THEN 'gadget' END AS fixed FROM part""")
def _(t):
    w = F.split_part("p_name", F.lit(" "), F.lit(2))
    return t.part.select("p_partkey", tx.fix_word(w, {"ring": "band", "bolt": "screw"}, {"gizmo": "gadget", "ring": "never"}).alias("fixed"))


@query("sha256_text", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(t):
    return spread(t.documents).select("doc_id", tx.sha256_text("text").alias("h"))


@query("hash_identifier", """SELECT c_custkey, left(sha256('pepper:' || c_custkey), 16) AS salted, left(sha256(CAST(c_custkey AS VARCHAR)), 16) AS plain,
  left(sha256(CASE WHEN CAST(c_custkey AS VARCHAR) < c_mktsegment THEN c_custkey || ':' || c_mktsegment ELSE c_mktsegment || ':' || c_custkey END), 16) AS scope FROM customer""")
def _(t):
    return t.customer.select("c_custkey", tx.hash_identifier("c_custkey", "pepper").alias("salted"), tx.hash_identifier("c_custkey").alias("plain"),
                             tx.hash_scope(F.array(F.col("c_mktsegment"), F.col("c_custkey").cast("string"))).alias("scope"))


@query("keyword_count", "SELECT conv_id, turn, CAST(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in ["the", "und", "tion", "de la"]) + " AS INT) AS n FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", kw.keyword_count(F.col("text"), ["the", "und", "tion", "de la"]).alias("n"))


RULES = [("german", ["ung", "keit"]), ("french", ["eau", "ç"]), ("english", ["the"])]


@query("first_keyword_category", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'ung') OR contains(lower(text), 'keit') THEN 'german' WHEN contains(lower(text), 'eau') OR contains(lower(text), 'ç') THEN 'french' WHEN contains(lower(text), 'the') THEN 'english' ELSE 'other' END AS category FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", kw.first_category(F.col("text"), RULES, "other").alias("category"))


@query("best_keyword", """WITH a AS (SELECT conv_id, turn, contains(lower(text), 'ung')::INT + contains(lower(text), 'keit')::INT AS g, contains(lower(text), 'eau')::INT + contains(lower(text), 'ç')::INT AS f, contains(lower(text), 'the')::INT AS e FROM conversations)
 SELECT conv_id, turn, CASE WHEN greatest(g, f, e) = 0 THEN NULL WHEN g = greatest(g, f, e) THEN 'german' WHEN f = greatest(g, f, e) THEN 'french' ELSE 'english' END AS category FROM a""")
def _(t):
    return t.conversations.select("conv_id", "turn", kw.best_keyword(F.col("text"), RULES).alias("category"))


@query("most_common", """WITH a AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS f FROM events GROUP BY 1, 2)
 SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM a) WHERE rn = 1""")
def _(t):
    g = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("f"))
    return first_per(g, ["user_id"], [F.desc("n"), "f"]).drop("f")


@query("arrays_maps_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id || ',' || event_type AS roles FROM events")
def _(t):
    e = t.events.withColumn("m", F.from_json("props", "map<string,bigint>"))
    back = F.from_json(F.to_json(F.map_filter("m", lambda k, v: v.isNotNull())), "map<string,bigint>")
    return e.select("event_id", F.try_element_at(back, F.lit("k")).alias("k"),
                    F.array_join(F.split(F.concat_ws(",", "user_id", "event_type"), ","), ",").alias("roles"))


# -- time columns ------------------------------------------------------------------------

@query("parse_ts_multi", f"""SELECT event_id, {txt("date_trunc('second', ts)")} AS ts, CASE event_id % 4 WHEN 0 THEN 'us_ampm' WHEN 1 THEN 'slash' WHEN 2 THEN 'iso_t' ELSE 'dash_space_offset' END AS layout,
  round(CASE event_id % 4 WHEN 0 THEN CASE WHEN length(strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p')) = 22 THEN 1.0 ELSE 0.8 * 1.05 END ELSE 1.0 END, 6) AS confidence FROM events""")
def _(t):
    k, ts = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    text = (F.when(k == 0, F.date_format(ts, "M/d/yyyy h:mm:ss a")).when(k == 1, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
            .when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" +0200"))))
    e = t.events.select("event_id", text.alias("x"))
    return e.select("event_id", tc.parse_stamp("x").alias("ts"), tc.stamp_layout("x").alias("layout"), F.round(tc.stamp_confidence("x", 2026), 6).alias("confidence"))


@query("to_standard", """SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS std, CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS iso FROM events""")
def _(t):
    ts = F.when(F.col("event_type") != "error", F.col("ts"))
    return t.events.select("event_id", tc.standard_form(ts).alias("std"), tc.iso_form(ts).alias("iso"))


@query("ts_with_zone", f"""WITH a AS (SELECT event_id, date_trunc('second', ts) AS ts FROM events)
 SELECT event_id, {txt('ts')} AS dropped, {txt('CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 5 HOUR + INTERVAL 1 HOUR ELSE ts END')} AS zoned FROM a""")
def _(t):
    s = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    x = F.when(F.col("event_id") % 2 == 0, F.concat(s, F.lit("+05:00"))).otherwise(s)
    e = t.events.select("event_id", x.alias("x"))
    return e.select("event_id", tc.parse_stamp("x").alias("dropped"), tc.to_zone("x").alias("zoned"))


@query("valid_ts", "SELECT event_id, event_type <> 'error' AS valid FROM events")
def _(t):
    x = F.when(F.col("event_type") == "error", F.lit("31/31/2024")).otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", tc.parse_stamp(x).isNotNull().alias("valid"))


@query("week_keys", """SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS iso, strftime(o_orderdate, '%Y-W%W') AS monday, strftime(date_trunc('week', o_orderdate), '%Y-W%U') AS sunday, strftime(o_orderdate, '%Y-W%V') AS calendar FROM orders""")
def _(t):
    d = "o_orderdate"
    return t.orders.select("o_orderkey", tc.iso_week(d).alias("iso"), tc.monday_week(d).alias("monday"), tc.sunday_week_of_monday(d).alias("sunday"), tc.calendar_year_iso_week(d).alias("calendar"))


@query("round_5min_table", f"""WITH a AS (SELECT event_id, date_trunc('hour', ts) AS h, extract(minute FROM ts) AS m FROM events)
 SELECT event_id, {txt('h + to_minutes(CASE WHEN m <= 3 THEN 0 WHEN m <= 7 THEN 5 WHEN m <= 11 THEN 10 WHEN m <= 18 THEN 15 WHEN m <= 23 THEN 20 WHEN m <= 28 THEN 25 WHEN m <= 33 THEN 30 WHEN m <= 38 THEN 35 WHEN m <= 43 THEN 40 WHEN m <= 48 THEN 45 WHEN m <= 53 THEN 50 WHEN m <= 56 THEN 55 ELSE 60 END)')} AS r FROM a""")
def _(t):
    return t.events.select("event_id", tc.round_5min("ts").alias("r"))


@query("clip_duration", f"""WITH {SHIFTED_SQL}, a AS (SELECT o_orderkey, s + to_seconds(o_orderkey % 3600) AS s, e FROM sh)
 SELECT o_orderkey, {txt("CASE WHEN epoch_us(e) - epoch_us(s) <= 39600000000 THEN e ELSE time_bucket(INTERVAL 5 MINUTE, s + INTERVAL 11 HOUR) END")} AS "end" FROM a""")
def _(t):
    w = fx.shifted(t).select("o_orderkey", F.expr("timestampadd(SECOND, cast(o_orderkey % 3600 as int), start)").alias("start"), "end")
    return w.select("o_orderkey", tc.clip_duration("start", "end").alias("end"))


@query("hours_between", f"""WITH {SHIFTED_SQL} SELECT o_orderkey, CAST(trunc({hrs('s', 'e')} * 60) AS BIGINT) AS minutes, round(greatest(0.0, {hrs("greatest(s, o_d + INTERVAL 9 HOUR)", "least(e, o_d + INTERVAL 17 HOUR)")}), 6) AS overlap,
  round(abs({hrs('s', 'e')}), 6) AS hours FROM (SELECT *, date_trunc('day', s) AS o_d FROM sh)""")
def _(t):
    w = fx.shifted(t)
    d = tc.day_start(F.to_date("start"))
    return w.select("o_orderkey", tc.minutes_between("start", "end").alias("minutes"),
                    F.round(tc.overlap_hours("start", "end", d + F.expr("INTERVAL '9' HOUR"), d + F.expr("INTERVAL '17' HOUR")), 6).alias("overlap"),
                    F.round(tc.event_hours("start", "end"), 6).alias("hours"))


@query("hours_between_mixed_tz", f"""WITH {SHIFTED_SQL} SELECT o_orderkey, round(CASE WHEN e < s THEN CASE WHEN o_totalprice / 100000 > 0 THEN o_totalprice / 100000 ELSE 0 END ELSE {hrs("s", "e")} END, 4) AS hours FROM sh""")
def _(t):
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    w = fx.shifted(t).select("o_orderkey", "o_totalprice", F.concat(F.date_format(F.col("start").cast("timestamp"), iso), F.lit("+02:00")).alias("a"),
                             F.date_format(F.col("end").cast("timestamp"), iso).alias("b"))
    h, back = tc.hours_between(tc.parse_stamp("a"), tc.parse_stamp("b")), F.col("o_totalprice") / 100000
    return w.select("o_orderkey", F.round(F.when(h < 0, F.greatest(back, F.lit(0.0))).otherwise(h), 4).alias("hours"))


# -- chunks --------------------------------------------------------------------------------

@query("chunk_fixed", """SELECT doc_id, i AS n, sha256(substring(text, i * 462 + 1, 512)) AS h FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 461) // 462)) AS i FROM documents)""")
def _(t):
    return spread(t.documents).select("doc_id", F.posexplode(C.fixed_width("text")).alias("n", "c")).select("doc_id", F.col("n").cast("long").alias("n"), F.sha2("c", 256).alias("h"))


@query("chunk_fixed_lateral", """SELECT doc_id, i AS n, sha256(substring(text, i * 462 + 1, 512)) AS h FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 461) // 462)) AS i FROM documents WHERE NOT regexp_full_match(text, '\\s*'))""")
def _(t):
    """The chunker as a table function, called from SQL text."""
    from ..operators import table_functions as U

    U.register(t.spark)
    return t.spark.sql("SELECT d.doc_id, CAST(c.chunk_index AS BIGINT) AS n, sha2(c.text, 256) AS h FROM {docs} d, LATERAL chunk_fixed(d.text, 512, 50) c", docs=spread(t.documents))


@query("chunk_recursive")
def _(t):
    c = C.chunk_table(spread(t.documents).select("doc_id", "text"), "doc_id", F.array("text"), "recursive")
    return c.select("doc_id", "chunk_index", "page_number", "is_empty_page", "content_hash", "raw_length")


@query("chunk_semantic")
def _(t):
    c = C.chunk_table(spread(t.documents).select("doc_id", "text"), "doc_id", F.array("text"), "semantic")
    return c.select("doc_id", "chunk_index", "is_empty_page", "content_hash", "raw_length")


def sentence_sql(budget, overlap):
    end = C.SENTENCE_END.replace("'", "''")
    no_end = C.NO_END.replace("'", "''")
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D\x1C-\x1F]+'), lambda x: x <> '') AS ws FROM documents),
 e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
 f AS (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM e),
 g AS (SELECT doc_id, word, i, regexp_matches(word, '{end}') AND NOT regexp_matches(word, '{no_end}') AND NOT coalesce(regexp_matches(next, '^[a-z]'), false) AS ends FROM f),
 h AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM g),
 sn AS (SELECT doc_id, s, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM h GROUP BY doc_id, s),
 d AS (SELECT doc_id, list(t ORDER BY s) AS t, list(n ORDER BY s) AS n, list_prepend(0::HUGEINT, list(p ORDER BY s)) AS p FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM sn) GROUP BY doc_id),
 c(doc_id, k, a, b) AS (
  SELECT doc_id, 0, 1, greatest(1, len(list_filter(p[2:], lambda x: x <= {budget}))) FROM d
  UNION ALL SELECT doc_id, k, a, a - 1 + greatest(1, len(list_filter(p[a + 1:], lambda x: x - p[a] <= {budget}))) FROM (
   SELECT d.doc_id, k + 1 AS k, d.p, b + 1 - len(list_filter(d.p[a + 1:b], lambda x: d.p[b + 1] - x <= least({overlap}, {budget} - d.n[b + 1]))) AS a
   FROM c JOIN d ON d.doc_id = c.doc_id AND c.b < len(d.n)))
 SELECT doc_id, k AS chunk_index, sha256(array_to_string(t[a:b], ' ')) AS content_hash, list_sum(n[a:b])::BIGINT AS words FROM c JOIN d USING (doc_id)"""


@query("chunk_sentences", sentence_sql(60, 15))
def _(t):
    """Whole sentences in chunks of 60 words, up to 15 words of them again in the next chunk."""
    c = C.sentence_chunks(spread(t.documents).select("doc_id", "text"), "text", 60, 15)
    c = c.select("doc_id", F.posexplode("chunks").alias("chunk_index", "c"))
    return c.select("doc_id", "chunk_index", F.sha2("c", 256).alias("content_hash"), F.size(F.split("c", " ")).cast("long").alias("words"))


CHUNKS_SQL = f"""pg AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
 pc AS (SELECT doc_id, page, p, unnest(CASE WHEN regexp_replace(p, '{SP}', '', 'g') = '' THEN [0] ELSE range(0, (length(p) + 461) // 462) END) AS i FROM pg),
 rc AS (SELECT doc_id, page, i, CASE WHEN regexp_replace(p, '{SP}', '', 'g') = '' THEN '' ELSE substring(p, i * 462 + 1, 512) END AS raw FROM pc),
 cl AS (SELECT *, {clean_sql('raw')} AS c FROM rc),
 ch AS (SELECT doc_id, page AS page_number, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) - 1 AS chunk_index, coalesce({useful_sql('c')}, '') AS text, length(raw) AS raw_length FROM cl)"""


def fixed_chunks(t):
    return C.chunk_table(spread(t.documents).select("doc_id", "text"), "doc_id", F.split("text", "\n"), "fixed")


@query("chunk_metadata", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, doc_id || '_' || chunk_index AS document_id, page_number, text = '' AS is_empty_page, sha256(text) AS content_hash FROM ch")
def _(t):
    return fixed_chunks(t).drop("text", "raw_length")


@query("page_chunks", f"WITH {CHUNKS_SQL} SELECT doc_id, page_number, count(*) AS n, sha256(string_agg(text, '|' ORDER BY chunk_index)) AS h FROM ch GROUP BY 1, 2")
def _(t):
    p = C.page_chunks(fixed_chunks(t), "doc_id")
    return p.select("doc_id", "page_number", "n", F.sha2(F.array_join(F.transform("chunks", lambda c: c["text"]), "|"), 256).alias("h"))


@query("embed_filter", f"WITH {CHUNKS_SQL} SELECT doc_id || '_' || chunk_index AS document_id, page_number, sha256(text) AS content_hash FROM ch WHERE text <> ''")
def _(t):
    return C.records_to_embed(fixed_chunks(t), "doc_id").select("document_id", "page_number", "content_hash")


@query("chunk_stats", f"""WITH {CHUNKS_SQL} SELECT d.doc_id, count(*) AS total_chunks, count(*) FILTER (ch.text = '') AS filtered_chunks, round(avg(length(ch.text)), 4) AS mean_length,
  round(avg({alnum_sql('ch.text')}), 6) AS mean_alnum, any_value(sha256(d.text)) AS document_hash FROM documents d JOIN ch USING (doc_id) GROUP BY 1""")
def _(t):
    s = C.chunk_stats(t.documents, "doc_id", F.split("text", "\n"), fixed_chunks(t))
    return s.withColumn("mean_length", F.round("mean_length", 4)).withColumn("mean_alnum", F.round("mean_alnum", 6))


@query("scan_chunks", f"WITH {CHUNKS_SQL} SELECT doc_id || '_' || chunk_index AS record_id, sha256(text) AS h FROM ch WHERE chunk_index >= 0 AND text <> ''")
def _(t):
    from ..sources import scans

    c = fixed_chunks(t).select(F.col("document_id").alias("id"), "chunk_index", F.when(F.col("page_number") == 1, None).otherwise(F.col("text")).alias("text"),
                               F.create_map(F.lit("text"), F.col("text")).alias("metadata"))
    return scans.scan_chunks(c, limit=None).filter("text <> ''").select(F.col("id").alias("record_id"), F.sha2("text", 256).alias("h"))


# -- the remaining functions of combined inventory lines -----------------------------------------

@query("to_iso", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def _(t):
    return t.orders.select("o_orderkey", tc.iso_form("o_orderdate").alias("iso"))


@query("ts_drop_offset", f"SELECT event_id, {txt("date_trunc('second', ts)")} AS ts FROM events")
def _(t):
    s = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit("-0730"))
    return t.events.select("event_id", tc.parse_stamp(s).alias("ts"))


@query("validate_format", "SELECT event_id, event_id % 3 <> 2 AS valid FROM events")
def _(t):
    k, ts = F.col("event_id") % 3, F.col("ts").cast("timestamp")
    s = F.when(k == 0, F.date_format(ts, "yyyy/MM/dd HH:mm:ss")).when(k == 1, F.date_format(ts, "M/d/yyyy h:mm:ss a")).otherwise(F.date_format(ts, "dd MMM yyyy"))
    return t.events.select("event_id", tc.stamp_layout(s).isNotNull().alias("valid"))


@query("format_confidence", """SELECT o_orderkey, round(least(1.0, CASE WHEN extract(year FROM o_orderdate) < 2020 THEN 1.1 * 0.7 * 1.05 ELSE 1.1 * 1.05 END), 6) AS confidence FROM orders""")
def _(t):
    s = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return t.orders.select("o_orderkey", F.round(tc.stamp_confidence(s, 2026), 6).alias("confidence"))


@query("safe_to_zone", f"SELECT event_id, {txt("CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) + INTERVAL 1 HOUR END")} AS local FROM events")
def _(t):
    s = F.when(F.col("event_type") == "error", "never").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.events.select("event_id", tc.to_zone(s).alias("local"))


@query("floor_5min", f"SELECT event_id, {txt('time_bucket(INTERVAL 5 MINUTE, ts)')} AS ts FROM events")
def _(t):
    return t.events.select("event_id", tc.floor_5min("ts").alias("ts"))


@query("break_minutes", f"WITH {SHIFTED_SQL} SELECT o_orderkey, CAST(trunc({hrs('s', 'e')} * 60) AS BIGINT) AS minutes FROM sh")
def _(t):
    return fx.shifted(t).select("o_orderkey", tc.minutes_between("start", "end").alias("minutes"))


@query("overlap_hours", f"WITH {SHIFTED_SQL} SELECT o_orderkey, round(greatest(0.0, {hrs("greatest(s, date_trunc('day', s) + INTERVAL 8 HOUR)", "least(e, date_trunc('day', s) + INTERVAL 18 HOUR)")}), 4) AS hours FROM sh")
def _(t):
    d = tc.day_start(F.to_date("start"))
    return fx.shifted(t).select("o_orderkey", F.round(tc.overlap_hours("start", "end", d + F.expr("INTERVAL '8' HOUR"), d + F.expr("INTERVAL '18' HOUR")), 4).alias("hours"))


@query("chunk_quality", f"SELECT conv_id, turn, length(regexp_replace(text, '^{SP}+|{SP}+$', '', 'g')) >= 10 AND {alnum_sql('text')} >= 0.75 AS ok FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", (tx.chunk_quality("text") & (tx.alnum_ratio("text") >= 0.75)).alias("ok"))


@query("repo_name", "SELECT page_id, regexp_replace(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]+)$', 1), '[.][^.]*$', '') AS name FROM pages")
def _(t):
    return t.pages.select("page_id", tx.stem(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))).alias("name"))


@query("doc_id", "SELECT doc_id, source || '_' || row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS record FROM documents")
def _(t):
    from ..scale import Ordered, position

    o = Ordered(t.documents.select("doc_id", "source"), ["source"], ["doc_id"]).add(n=position()).rows()
    return o.select("doc_id", F.concat_ws("_", "source", F.col("n") - 1).alias("record"))


@query("sha256_file", "SELECT page_id, sha256(html) AS h, octet_length(encode(html)) AS bytes FROM pages")
def _(t):
    b = F.encode("html", "UTF-8")
    return t.pages.select("page_id", F.sha2(b, 256).alias("h"), F.octet_length(b).alias("bytes"))


@query("activity_score", """WITH a AS (SELECT p_partkey, lower(p_name) AS d, lower(p_type) AS c FROM part)
 SELECT p_partkey, round((least((contains(d, 'red')::INT + contains(d, 'ring')::INT) / 2.0, 1.0) + CASE WHEN c = 'promo' THEN 0.0 ELSE least((contains(c, 'red')::INT + contains(c, 'ring')::INT) / 4.0, 1.0) END
   + 0.5 * contains(d, 'bolt')::INT) / CASE WHEN c = 'promo' THEN 1.5 ELSE 2.5 END, 6) AS score FROM a""")
def _(t):
    act = {"keywords": ["red", "ring"], "sub_activities": [{"keywords": ["bolt"]}]}
    commits = F.when(F.col("p_type") != "PROMO", F.lower("p_type"))
    return t.part.select("p_partkey", F.round(kw.activity_score(act, F.lower("p_name"), commits), 6).alias("score"))


@query("postal_to_region", "SELECT c_custkey, left(lpad(CAST(c_custkey AS VARCHAR), 4, '0'), 2) || 'xx regio' AS region FROM customer")
def _(t):
    from ..functions.privacy import postal_to_region

    return t.customer.select("c_custkey", postal_to_region(F.concat(F.lpad(F.col("c_custkey").cast("string"), 4, "0"), F.lit(" AB"))).alias("region"))
