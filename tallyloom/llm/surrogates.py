"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

Column expressions, joins and aggregations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, given, written

# The forms of the entities (Java regular expressions).
EMAIL = r"(?<![\p{L}\p{N}_.+%-])[\p{L}\p{N}_.+%-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])"
ADDRESS = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[\p{L}\p{N}])"
PHONE = (r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}(?![0-9])"
         r"|(?<![\p{L}\p{N}+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9])")
SOCIAL = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
CARD = r"(?<![\p{L}\p{N}.-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.-])3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}(?![\p{L}\p{N}])"
# A key word anywhere in a name such as DB_PASSWORD or password_hash, but not secretary or tokenizer; the rest of the
# name ends where another key word or entity begins.
KEY_WORD = r"(?i:password|passwd|secret|token|api[ _-]?key)(?!ar[iy]|ion|i[sz](?:e|ation|ing))"
SECRET = (rf"{KEY_WORD}(?:(?!{KEY_WORD}|{IBAN}|{PHONE}|{SOCIAL}|{CARD}|{ADDRESS})[A-Za-z0-9_.-])*+[\"']? ?[=:] ?[\"']?"
          r"(?=[^\s\"']*[\p{L}\p{N}])[^\s\"']{6,}")
NAME = (r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Srta)\.? \p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+){0,2}"
        r"|(?<![\p{L}\p{N}])(?:г-н|г-жа|[Гг]осподин|[Гг]оспожа) \p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+){0,2}")
ENTITY = "|".join((EMAIL, SECRET, IBAN, PHONE, SOCIAL, CARD, ADDRESS, NAME))
#: What every entity has: a cheap test that spares most texts the full one.
HINT = r"[0-9@]|(?i:password|passwd|secret|token|api[ _-]?key)|(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Srta)\.? \p{Lu}|г-н|г-жа|осподин|оспожа"
MALE = r"^(?:Mr|Herr|Sr|г-н|[Гг]осподин)\b"
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Mme|Mlle|Sra|Srta|г-жа|[Гг]оспожа)"

# Surrogate given names by gender and script, and syllables of family names by script.
GIVEN = {
    "m-latin": "Adam Bruno Carl David Edgar Felix Georg Hugo Ivan Jonas Karl Leon Martin Niels Oscar Paul Ralf Simon Thomas Viktor",
    "f-latin": "Anna Berta Clara Diana Elena Flora Greta Helga Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Tanja Vera",
    "n-latin": "Alex Billie Casey Dana Eden Frankie Gale Harper Indigo Jamie Kim Lee Morgan Noel Parker Quinn Robin Sam Taylor Val",
    "m-cyrillic": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Семён Тимур Фёдор",
    "f-cyrillic": "Анна Белла Вера Галина Дарья Елена Жанна Зоя Инна Клара Лидия Мария Нина Ольга Полина Римма",
    "n-cyrillic": "Женя Саша Валя Слава Шура Паша Никита Витя",
}
SYLLABLES = {
    "latin": "bal cor den fal gar hol jen kel lam mor nav per quin ros sil tar ul ver wen zol",
    "cyrillic": "бал вор ган дол зем кар лен мор нов пет рос сол тар фед хол чер",
}
ENDINGS = {"m-latin": "o", "f-latin": "a", "n-latin": "i", "m-cyrillic": "ей", "f-cyrillic": "ия", "n-cyrillic": "и"}
#: Draws in the form of the entity; later ones are one character longer every so many draws.
IN_FORM = 3


def _words(text: str) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in text.split()) + ")"


def _kind(e: str) -> str:
    digits = f"length(regexp_replace({e}, '[^0-9]', ''))"
    return (f"CASE WHEN {e} RLIKE '[=:]' THEN 'secret' WHEN contains({e}, '@') THEN 'email' "  # no other entity has = or :
            f"WHEN {e} RLIKE '^[A-Z]{{2}}[0-9]{{2}}' THEN 'iban' "
            f"WHEN {e} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN 'address' "
            f"WHEN {e} RLIKE '^[+(]' THEN 'phone' WHEN {e} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'social' "
            f"WHEN {e} RLIKE '^[0-9]' AND {digits} >= 12 THEN 'card' WHEN {e} RLIKE '^[0-9]' THEN 'phone' ELSE 'name' END")


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def occurrences(texts: DataFrame) -> DataFrame:
    """``(f1, f2, place, part, found, kind, canon)``: every entity of each text; names come word by word.

    ``canon`` is what spellings of one entity have in common: lower case, digits without layout.
    """
    each = texts.select("f1", "f2", F.posexplode(F.expr(f"regexp_extract_all(text, '{_sql(ENTITY)}', 0)")).alias("place", "found"))
    each = each.withColumn("kind", F.expr(_kind("found")))
    name = F.regexp_extract("found", r"^\S+ (.*)$", 1)
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.when(F.col("found").rlike(MALE), "m").when(F.col("found").rlike(FEMALE), "f").otherwise("n")
    parts = F.split(name, "[ -]")
    named = each.filter("kind = 'name'").select(
        "f1", "f2", "place", "found", script.alias("script"), gender.alias("gender"), F.size(parts).alias("n"), F.posexplode(parts).alias("part", "word")) \
        .select("f1", "f2", "place", "part", "found",
                F.when((F.col("part") == 0) & (F.col("n") > 1), F.concat(F.lit("given-"), "gender", F.lit("-"), "script"))
                .otherwise(F.concat(F.lit("family-"), "script")).alias("kind"), F.lower("word").alias("canon"))
    canon = F.expr(
        "CASE kind WHEN 'email' THEN lower(found) WHEN 'secret' THEN regexp_extract(found, '(?s)[=:] ?[\"\\']?(.*)$', 1) "
        "WHEN 'iban' THEN replace(found, ' ', '') WHEN 'phone' THEN regexp_replace(found, '[^0-9+]', '') "
        "WHEN 'address' THEN found ELSE regexp_replace(found, '[^0-9]', '') END")
    other = each.filter("kind <> 'name'").select("f1", "f2", "place", F.lit(0).alias("part"), "found", "kind", canon.alias("canon"))
    return other.unionByName(named)


def _proposed(entities: DataFrame, key: str) -> DataFrame:
    """Add ``surrogate`` to ``(kind, canon, attempt)``: drawn from a keyed hash stream of 16 bits a character."""
    secret = key.replace("\\", "\\\\").replace("'", "\\'")
    stream = (f"array_join(transform(sequence(0, int((length(canon) + 40 + attempt) / 32)), "
              f"b -> sha2(concat('{secret}', sha2(concat_ws('|', '{secret}', kind, canon, attempt, b), 256)), 512)), '')")

    def n(i) -> str:
        return f"int(conv(substring(stream, 4 * ({i}) + 1, 4), 16, 10))"

    def drawn(text: str, shift: str = "0", hexed: bool = False) -> str:
        """A character of the same class for each: digit, lower, upper, Cyrillic lower and upper, Greek; other digits become plain, the rest stays."""
        k = n(f"i + {shift}")
        letters = f"WHEN c RLIKE '[a-f]' AND hexed THEN substring('abcdef', {k} % 6 + 1, 1) " if hexed else ""
        return (f"array_join(transform(filter(split({text}, ''), c -> c <> ''), (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN string({k} % 10) {letters}"
                f"WHEN c RLIKE '[а-яё]' THEN substring('абвгдежзиклмнопрстуфхцчшэюя', {k} % 27 + 1, 1) "
                f"WHEN c RLIKE '[А-ЯЁ]' THEN substring('АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ', {k} % 27 + 1, 1) "
                f"WHEN c RLIKE '[α-ω]' THEN substring('αβγδεζηθικλμνξοπρστυφχψω', {k} % 24 + 1, 1) "
                f"WHEN c RLIKE '\\\\p{{Lu}}' THEN char(65 + {k} % 26) WHEN c RLIKE '\\\\p{{L}}' THEN char(97 + {k} % 26) WHEN c RLIKE '\\\\p{{N}}' THEN string({k} % 10) ELSE c END), '')")

    length = "length(canon)"

    def more(one: str, join: str = "", after: int = IN_FORM) -> str:
        """What draws from ``after`` on add, so that no space is too small: ``one`` of a random number each, with ``join`` before it."""
        drawn_one = one.format(n(f"{length} + 40 + i"))
        return f"CASE WHEN attempt < {after} THEN '' ELSE array_join(transform(sequence(1, 1 + int((attempt - {after}) / {IN_FORM})), i -> concat('{join}', {drawn_one})), '') END"

    digit, letter = more("string({} % 10)"), more("char(97 + {} % 26)")
    either = more("CASE WHEN hexed THEN substring('0123456789abcdef', {0} % 16 + 1, 1) ELSE char(97 + {0} % 26) END")
    host = f"concat(array_join(transform(sequence(0, 7), i -> char(97 + {n(f'{length} + i')} % 26)), ''), {letter})"
    email = f"concat({drawn(chr(39).join(['substring_index(canon, ', '@', ', 1)']))}, '@', {host}, '.example.', element_at(array('com', 'org', 'net'), {n(f'{length} + 8')} % 3 + 1))"
    keep = "CASE WHEN canon LIKE '+1%' OR canon LIKE '+7%' THEN 2 WHEN canon LIKE '+%' THEN 3 ELSE 0 END"
    phone = f"concat(substring(canon, 1, {keep}), string(2 + {n(34)} % 8), {drawn(f'substring(canon, {keep} + 2)')}, {digit})"
    body = f"concat(substring(canon, 1, 1), {drawn('substring(canon, 2, length(canon) - 2)')}, {digit})"
    luhn = (f"transform(array({body}), b -> concat(b, string((10 - aggregate(transform(filter(split(reverse(b), ''), c -> c <> ''), "
            "(c, i) -> CASE WHEN i % 2 = 1 THEN int(c) WHEN int(c) > 4 THEN 2 * int(c) - 9 ELSE 2 * int(c) END), 0, (s, v) -> s + v) % 10) % 10)))[0]")
    inner = f"concat({drawn('substring(canon, 5)')}, {digit})"
    iban = (f"transform(array({inner}), b -> concat(substring(canon, 1, 2), lpad(string(98 - aggregate(filter(split(concat(b, substring(canon, 1, 2), '00'), ''), c -> c <> ''), "
            "0, (s, c) -> CASE WHEN c RLIKE '[0-9]' THEN (s * 10 + int(c)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END)), 2, '0'), b))[0]")
    part = more("string({} % 256)", ".", after=8 * IN_FORM)  # 250 million addresses have four parts
    address = f"concat(concat_ws('.', 240 + {n(0)} % 15, {n(1)} % 256, {n(2)} % 256, 1 + {n(3)} % 254), {part})"
    family, made = "CASE kind ", "CASE kind "
    for script, syllables in SYLLABLES.items():
        list_ = _words(syllables)
        several = f"array_join(transform(sequence(0, 2 + int(attempt / 4)), i -> element_at({list_}, {n('i')} % {len(syllables.split())} + 1)), '')"
        family += f"WHEN 'family-{script}' THEN initcap({several}) "
        for group, names in GIVEN.items():
            if group.endswith(script):
                made += (f"WHEN 'given-{group}' THEN CASE WHEN attempt < 3 THEN element_at({_words(names)}, {n(0)} % {len(names.split())} + 1) "
                         f"ELSE initcap(concat({several}, '{ENDINGS[group]}')) END ")
    surrogate = (f"CASE WHEN kind = 'email' THEN {email} WHEN kind = 'phone' THEN {phone} WHEN kind = 'card' THEN {luhn} "
                 f"WHEN kind = 'iban' THEN {iban} WHEN kind = 'address' THEN {address} WHEN kind = 'social' THEN concat('9', {drawn('substring(canon, 2)')}, {digit}) "
                 f"WHEN kind = 'secret' THEN concat({drawn('canon', hexed=True)}, {either}) WHEN kind LIKE 'family%' THEN {family} END ELSE {made} END END")
    return entities.withColumn("stream", F.expr(stream)).withColumn("hexed", F.expr("canon RLIKE '^[0-9a-f]+$'")) \
        .withColumn("surrogate", F.expr(surrogate)).select("kind", "canon", "attempt", "surrogate")


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, canon, surrogate)`` for distinct ``(kind, canon)``: no two share a surrogate, none is an entity of the corpus.

    Of entities that draw the same surrogate, the smallest keeps it; the others, and all that draw a
    real entity, draw again.  Rounds end when nothing clashes; as every type's space grows with the draws
    (a character or a syllable more), they do end, however small the space of the entity's own form.
    """
    now = cut_lineage(_proposed(entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)), key))
    real = now.select("kind", F.col("canon").alias("taken")).withColumn("real", F.lit(True))
    while True:
        drawn = F.lower("surrogate")
        first = now.groupBy("kind", drawn.alias("taken")).agg(F.min("canon").alias("first"))
        judged = now.withColumn("taken", drawn).join(first, ["kind", "taken"]).join(
            real.select("kind", F.lower("taken").alias("taken"), "real").distinct(), ["kind", "taken"], "left")
        judged = cut_lineage(judged.withColumn("again", (F.col("canon") != F.col("first")) | F.coalesce("real", F.lit(False)))
                             .select("kind", "canon", "attempt", "surrogate", "again"))
        if judged.filter("again").isEmpty():
            return judged.select("kind", "canon", "surrogate")
        redrawn = _proposed(judged.filter("again").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), key)
        now = cut_lineage(judged.filter("NOT again").select("kind", "canon", "attempt", "surrogate").unionByName(redrawn))


def _laid_out(found: str, digits: str) -> str:
    """Surrogate digits in the layout of the text found, those of a longer surrogate behind it."""
    return (f"concat(array_join(transform(filter(split({found}, ''), c -> c <> ''), (c, i) -> CASE WHEN c RLIKE '[0-9]' "
            f"THEN substring({digits}, length(regexp_replace(substring({found}, 1, i + 1), '[^0-9]', '')), 1) ELSE c END), ''), "
            f"substring({digits}, length(regexp_replace({found}, '[^0-9]', '')) + 1))")


def surrogate_text(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced; other columns and all rows stay as they are.

    Types: e-mail and IPv4 addresses, phone, card, account (IBAN) and social security numbers, passwords and tokens, and
    names after a form of address.  One entity gets one surrogate in all texts and spellings (by name
    word, so "Dr. Ada Poe" and "Mrs. Poe" stay related), keyed by ``key``.  Card and account numbers get right
    check digits; addresses come from ranges that nobody holds; digits keep their layout.  Where the entities of a
    form leave no free surrogate of that form, it gets longer.  A secret without letters and digits is masked and stays.

    Only texts with an entity are shuffled, by fingerprint; equal texts are worked out once.  A null text
    stays null, an empty one empty; texts without an entity are untouched.  ``count_col`` adds the number of
    entities replaced.  An empty table gives an empty result.
    """
    text = F.col(f"`{text_col}`")
    has = F.coalesce(text.rlike(HINT) & text.rlike(ENTITY), F.lit(False))
    # the constant first: behind the text it would only hash the first hash again
    fingerprint = [F.xxhash64(text).alias("f1"), F.xxhash64(F.lit(17), text).alias("f2")]
    touched = given(docs, text=text_col).filter(F.coalesce(F.col("text").rlike(HINT), F.lit(False)) & F.col("text").rlike(ENTITY))
    found = written(occurrences(touched.select(F.xxhash64("text").alias("f1"), F.xxhash64(F.lit(17), "text").alias("f2"), "text")
                                ).dropDuplicates(["f1", "f2", "place", "part"]), "entities")
    chosen = assigned(found, key)

    digits = "regexp_replace(surrogate, '[^0-9]', '')"
    shown = F.expr(
        "CASE WHEN kind = 'email' AND found = upper(found) THEN upper(surrogate) "
        "WHEN kind = 'iban' AND contains(found, ' ') THEN regexp_replace(surrogate, '(.{4})(?!$)', '$1 ') "
        f"WHEN kind IN ('phone', 'card', 'social') THEN {_laid_out('found', digits)} "
        "WHEN kind = 'secret' THEN concat(regexp_extract(found, '^([^=:]*[=:] ?[\"\\']?)', 1), surrogate) ELSE surrogate END")
    parts = found.join(chosen, ["kind", "canon"]).withColumn("shown", shown) \
        .groupBy("f1", "f2", "place").agg(F.first("found").alias("found"), F.min("kind").alias("kind"),
                                          F.array_sort(F.collect_list(F.struct("part", "shown"))).alias("words"))
    named = F.expr("kind LIKE 'given%' OR kind LIKE 'family%'")
    joint = F.when(F.col("found").contains("-") & ~F.col("found").startswith("г-"), "-").otherwise(" ")
    whole = F.when(named, F.concat(F.regexp_extract("found", r"^(\S+ )", 1), F.array_join("words.shown", " "))).otherwise(F.array_join("words.shown", ""))
    del joint
    lists = parts.withColumn("shown", whole).groupBy("f1", "f2") \
        .agg(F.array_sort(F.collect_list(F.struct("place", "shown"))).alias("list"))

    names = docs.columns
    rest = docs.filter(~has)
    keyed = docs.filter(has).select(*fingerprint, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).alias("k")
    lists = lists.withColumnsRenamed({"f1": "g1", "f2": "g2"})
    both = keyed.join(lists, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))).select("row", "list")
    index = names.index(text_col)
    rebuilt = F.expr(
        f"array_join(zip_with(split(__text, '{_sql(ENTITY)}', -1), concat(list.shown, array('')), (gap, new) -> concat(gap, new)), '')")
    both = both.withColumn("__text", F.col("row")[text_col]).select("row", rebuilt.alias("text"), F.size("list").cast("long").alias("count"))
    out = both.select(*[F.col("text").alias(c) if i == index else F.col("row")[c].alias(c) for i, c in enumerate(names)],
                      *([F.col("count").alias(count_col)] if count_col else []))
    rest = rest.select(*[F.col(f"`{c}`") for c in names], *([F.lit(0).cast("long").alias(count_col)] if count_col else []))
    return rest.unionByName(out)
