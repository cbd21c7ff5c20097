"""Text columns: cleaning, statistics, tokens, headings, hashes."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as the text rules understand it (wider than the regex engine's plain \s).
SPACE = "[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                            0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Characters dropped from every text, and the shortest/least alphanumeric text kept.
CONTROL = "".join(map(chr, [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]))
MIN_LENGTH, MIN_ALNUM = 10, 0.1


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nfkc(text) -> Column:
    """Unicode compatibility form.  Spark has no built-in, so one Arrow-batched function; texts of ASCII alone
    are their own form and stay where they are."""

    def norm(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    t = _c(text)
    return F.coalesce(F.pandas_udf(norm, StringType())(F.when(~t.rlike("^[\\x00-\\x7F]*\\z"), t)), t)


def collapse(text) -> Column:
    """One blank for every run of white space, none at the ends.  Mapping rare blanks to ' ' first
    keeps the pattern trivial, several times cheaper than one wide character class."""
    return F.trim(F.regexp_replace(F.translate(_c(text), _SPACES, " " * len(_SPACES)), " {2,}", " "))


def _standard(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, CONTROL, ""), "[.!?]{3,}", "...")


def clean_text(text, normalize: bool = True, aggressive: bool = False) -> Column:
    """NFKC, one space between words, no control characters, long punctuation runs to '...'."""
    t = F.coalesce(_c(text), F.lit(""))
    t = _standard(collapse(nfkc(t) if normalize else t))
    if aggressive:
        t = collapse(F.regexp_replace(t, "[^\\x20-\\x7E\\n\\t]", ""))
    return t


def alnum_ratio(text) -> Column:
    t = _c(text)
    return F.when(F.length(t) > 0, F.regexp_count(t, F.lit("[a-zA-Z0-9]")) / F.length(t)).otherwise(0.0)


def keep_if_useful(cleaned: Column, min_length: int = MIN_LENGTH) -> Column:
    """Cleaned text, or null when too short or with too few letters and digits."""
    return F.when((F.length(F.trim(cleaned)) >= min_length) & (alnum_ratio(cleaned) >= MIN_ALNUM), cleaned)


def chunk_quality(text, min_length: int = MIN_LENGTH) -> Column:
    """The same test on raw text."""
    t = F.coalesce(_c(text), F.lit(""))
    return (F.length(collapse_ends(t)) >= min_length) & (alnum_ratio(t) >= MIN_ALNUM)


def collapse_ends(text) -> Column:
    return F.regexp_replace(_c(text), f"^{SPACE}+|{SPACE}+$", "")


def text_stats(text) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    n, al = F.length(t), F.regexp_count(t, F.lit("[a-zA-Z0-9]"))
    ws = F.regexp_count(t, F.lit(SPACE))
    words = F.when(F.length(collapse(t)) > 0, F.size(F.split(collapse(t), " "))).otherwise(0)

    def ratio(x):
        return F.when(n > 0, x / n).otherwise(0.0)

    return F.struct(n.alias("length"), words.alias("word_count"), ratio(al).alias("alphanumeric_ratio"),
                    ratio(ws).alias("whitespace_ratio"), ratio(n - al - ws).alias("special_char_ratio"))


def dehyphenate(text) -> Column:
    return collapse(F.regexp_replace(_c(text), "-\\n(?=[\\p{L}\\p{N}_])", ""))


def strip_controls(text) -> Column:
    return collapse(F.translate(_c(text), CONTROL, ""))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.titles, self.open = [], [], None

    def handle_starttag(self, tag, attrs):
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.open = []

    def handle_endtag(self, tag):
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            if self.open:
                self.titles.append(" ".join(self.open).strip())
            self.open = None

    def handle_data(self, data):
        self.parts.append(data)
        if self.open is not None:
            self.open.append(data)


EMPTY_HTML = "(No text content extracted from HTML)"


def html_text(html) -> Column:
    """struct(text, headings) of an HTML page: all text nodes, script and style included."""

    def parse(s: pd.Series) -> pd.DataFrame:
        out = []
        for v in s:
            p = _Text()
            p.feed(v or "")
            out.append(("".join(p.parts).strip() or EMPTY_HTML, p.titles))
        return pd.DataFrame(out, columns=["text", "headings"])

    return F.pandas_udf(parse, "text string, headings array<string>")(_c(html))


def strip_tags(html) -> Column:
    """JVM-only variant: comments and tags removed, entities left as they are."""
    return collapse_ends(F.regexp_replace(F.regexp_replace(_c(html), "(?s)<!--.*?-->", ""), "<[^>]*>", ""))


def html_headings(html) -> Column:
    """h1-h6 bodies without inner tags (JVM-only)."""
    raw = F.regexp_extract_all(_c(html), F.lit("(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), 1)
    return F.transform(raw, lambda h: F.trim(F.regexp_replace(h, "<[^>]*>", "")))


def markdown_headings(text) -> Column:
    return F.transform(F.regexp_extract_all(_c(text), F.lit("(?m)^#{1,6}\\s+(.+)$"), 1), lambda h: F.trim(h))


def tokens(text) -> Column:
    """Lower-case runs of a-z and 0-9; every other character separates."""
    return F.array_remove(F.split(F.lower(_c(text)), "[^a-z0-9]+"), "")


def normalize_match(text) -> Column:
    return F.lower(collapse(text))


def preview(text, n: int = 200) -> Column:
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


# File extensions and their media types.
MEDIA_TYPES = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword", "md": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html",
    "csv": "text/csv", "json": "application/json"}


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))


def stem(path) -> Column:
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def media_type(path) -> Column:
    e, out = extension(path), None
    for k, v in MEDIA_TYPES.items():
        out = F.when(e == k, v) if out is None else out.when(e == k, v)
    return out.otherwise("application/octet-stream")


def sha256_text(text) -> Column:
    return F.sha2(_c(text), 256)


def hash_identifier(ident, salt: str | None = None) -> Column:
    """First 16 hex digits of sha256, salted as ``salt:id`` when a salt is given."""
    i = _c(ident).cast("string")
    return F.left(F.sha2(F.concat_ws(":", F.lit(salt), i) if salt else i, 256), F.lit(16))


def hash_scope(ids) -> Column:
    return F.left(F.sha2(F.array_join(F.array_sort(_c(ids)), ":"), 256), F.lit(16))


def terms_in(text, terms: list[str]) -> Column:
    low = F.lower(_c(text))
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, F.lower(t)))


def fix_word(word, corrections: dict[str, str], abbreviations: dict[str, str]) -> Column:
    def table(d):
        return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])

    w = F.lower(_c(word))
    return F.coalesce(F.try_element_at(table(corrections), w), F.try_element_at(table(abbreviations), w))
