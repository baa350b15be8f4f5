"""Text and identity expressions; every function takes and gives Columns."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper-case Turkish letters beyond A-Z, and the decomposed pairs that NFC puts together (fixed values).
TURKISH_UPPER = "ÇĞİÖŞÜ"
COMPOSED = (("Ç", "Ç"), ("ç", "ç"), ("Ğ", "Ğ"), ("ğ", "ğ"), ("İ", "İ"), ("Ö", "Ö"), ("ö", "ö"), ("Ş", "Ş"), ("ş", "ş"), ("Ü", "Ü"), ("ü", "ü"))
ARTICLE_TYPES = ("normal", "ek", "gecici", "islenemeyen_hukum")
ARTICLE_LABELS = {"normal": "Madde", "ek": "Ek Madde", "gecici": "Geçici Madde", "islenemeyen_hukum": "Madde"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def normalize_paragraph(c: Column | str) -> Column:
    """Line ends to one space, ends stripped, inner spacing as it is."""
    return strip(F.replace(F.regexp_replace(col(c), "\r\n|\r", "\n"), F.lit("\n"), F.lit(" ")))


def article_no_legacy(c: Column | str) -> Column:
    """Lower case, dashes and underscores to slashes, no blanks around slashes."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(c), "[-_]", "/"), r"(?U)\s*/\s*", "/"))


def article_no(c: Column | str) -> Column:
    """Canonical: a segment with an upper-case Turkish letter is upper case, any other lower case; raises on a segment that isn't alphanumeric."""
    s = F.regexp_replace(F.regexp_replace(strip(c), "[-_]", "/"), r"(?U)\s*/\s*", "/")
    parts = F.transform(F.split(s, "/"), lambda p: F.when(p.rlike(f"[{TURKISH_UPPER}]"), F.upper(p)).otherwise(F.lower(p)))
    fine = F.forall(parts, lambda p: p.rlike(r"^[\p{L}\p{N}]+$"))
    return F.when(fine, F.array_join(parts, "/")).when(c_is_null(c), None).otherwise(F.raise_error(F.concat(F.lit("article number not valid: "), col(c))).cast("string"))


def c_is_null(c: Column | str) -> Column:
    return col(c).isNull()


def source_key(document_id: Column | str, article_type: Column | str, number: Column | str) -> Column:
    """document/type/number; raises on a document or type outside the grammar."""
    d, t = col(document_id), col(article_type)
    ok = d.rlike(r"^[a-z0-9]+([_-][a-z0-9]+)*$") & t.isin(*ARTICLE_TYPES)
    return F.when(ok, F.concat_ws("/", d, t, article_no(number))).otherwise(F.raise_error(F.concat(F.lit("source key not valid: "), F.coalesce(d, F.lit("null")))).cast("string"))


def parse_source_key(key: Column | str) -> Column:
    """struct(document_id, article_type, article_no); at most two slashes part, and the key must come out again."""
    p = F.split(col(key), "/", 3)
    again = source_key(p[0], p[1], p[2])
    return F.when(again == col(key), F.struct(p[0].alias("document_id"), p[1].alias("article_type"), p[2].alias("article_no"))).otherwise(F.raise_error(F.concat(F.lit("not canonical: "), col(key))).cast("struct<document_id:string,article_type:string,article_no:string>"))


def annex_key(document_id: Column | str, label: Column | str) -> Column:
    """document/annex/number[/letter] of a label such as EK-77/A, EK 77-A or EK 77 A; null where the label is none."""
    m = lambda k: F.regexp_extract(strip(label), r"(?iuU)^EK\s*[-–—]?\s*0*([1-9]\d*)(?:(?:\s*[/–—-]\s*|\s+)([A-Za-zÇĞİÖŞÜçğıöşü]))?$", k)
    return F.when(m(1) != "", F.concat(col(document_id), F.lit("/annex/"), m(1), F.when(m(2) != "", F.concat(F.lit("/"), F.lower(m(2)))).otherwise("")))


def annex_order(key: Column | str) -> Column:
    """By what annexes are in order: document, number, then the annex itself before its parts by letter."""
    p = F.split(col(key), "/")
    return F.struct(p[0].alias("document_id"), F.get(p, F.lit(2)).cast("int").alias("annex_no"), F.coalesce(F.get(p, F.lit(3)), F.lit("")).alias("subpart"))


def annex_storage_id(key: Column | str) -> Column:
    """d-ek-n[-x] of d/annex/n[/x]."""
    p = F.split(col(key), "/")
    return F.lower(F.array_join(F.concat(F.array(p[0], F.lit("ek")), F.slice(p, 3, 2)), "-"))


def section_context(*levels: Column | str) -> Column:
    return F.nullif(F.concat_ws(" > ", *map(col, levels)), F.lit(""))


def amendment_note(rest: Column | str) -> Column:
    """Leading groups in parentheses, joined by a space; a single bare number is no note."""
    head = F.regexp_extract(col(rest), r"(?U)^\s*((?:\([^)]*\)\s*)+)", 1)
    groups = F.regexp_extract_all(head, F.lit(r"(\([^)]*\))"), F.lit(1))
    return F.when((F.size(groups) == 0) | ((F.size(groups) == 1) & groups[0].rlike(r"^\(\d+\)$")), None).otherwise(F.array_join(groups, " "))


def article_label(article_type: Column | str, number: Column | str) -> Column:
    """Madde 5, Ek Madde 1, ...; a type that isn't one raises."""
    m = F.create_map(*(F.lit(x) for kv in ARTICLE_LABELS.items() for x in kv))
    t = col(article_type)
    name = F.when(t.isin(*ARTICLE_TYPES), F.element_at(m, t)).otherwise(F.raise_error(F.concat(F.lit("no article type: "), F.coalesce(t, F.lit("null")))).cast("string"))
    return F.concat_ws(" ", name, col(number))


def annex_label(number: Column | str, subpart: Column | str) -> Column:
    """EK-77 or EK-77/A; EK-? of a number that is none."""
    n, sub = col(number).cast("string"), col(subpart)
    fine = n.rlike(r"^[1-9]\d*$") & (sub.isNull() | sub.rlike(r"^\p{Lu}$"))
    return F.when(F.coalesce(fine, F.lit(False)), F.concat(F.lit("EK-"), n, F.coalesce(F.concat(F.lit("/"), sub), F.lit("")))).otherwise("EK-?")


def display_label(source_type: Column | str, article: Column | str, annex_no: Column | str, subpart: Column | str) -> Column:
    """What a result is shown as: the annex's label, else its article."""
    return F.when(col(source_type) == "annex", annex_label(annex_no, subpart)).otherwise(F.concat(F.lit("Madde "), F.coalesce(col(article).cast("string"), F.lit("?"))))


def citation(title: Column | str, law: Column | str, article_type: Column | str, number: Column | str, annex: Column | str, label: Column | str) -> Column:
    """A citation from trusted fields: the title, else the law's number; then the article or the annex; parts that aren't there are left out, and without any the label stands in brackets."""
    t, l = F.nullif(col(title), F.lit("")), F.nullif(col(law), F.lit(""))
    head = F.coalesce(t, F.concat(l, F.lit(" sayılı Kanun")))
    known = F.create_map(*(F.lit(x) for kv in ARTICLE_LABELS.items() for x in kv))
    article = F.when(F.nullif(col(number), F.lit("")).isNotNull(), F.concat_ws(" ", F.coalesce(F.try_element_at(known, F.coalesce(col(article_type), F.lit(""))), F.lit("Madde")), col(number)))
    parts = F.array_compact(F.array(head, F.coalesce(article, F.nullif(col(annex), F.lit("")))))
    made = F.when(t.isNotNull(), F.array_join(parts, " — ")).otherwise(F.array_join(parts, ", "))
    return F.when(F.size(parts) > 0, made).otherwise(F.concat(F.lit("["), col(label), F.lit("]")))


def annex_text(title: Column | str, label: Column | str, text: Column | str) -> Column:
    """What of an annex chunk is embedded: title and label by lines, an empty line, the exact text."""
    return F.concat(col(title), F.lit("\n"), col(label), F.lit("\n\n"), col(text))


def enriched_question(title: Column | str, question: Column | str) -> Column:
    return F.concat(col(title), F.lit("\n\n"), col(question))


def lexical_text(title: Column | str, section: Column | str, text: Column | str) -> Column:
    """What is searched by words: title, section and text by lines, absent ones left out."""
    return F.concat_ws("\n", F.nullif(col(title), F.lit("")), F.nullif(col(section), F.lit("")), col(text))


def percent(x: Column | str, digits: int = 1) -> Column:
    """0.875 as 87.5%; a rate over nothing as n/a."""
    return F.when(col(x).isNotNull(), F.format_string(f"%.{digits}f%%", col(x) * 100)).otherwise("n/a")


def embedding_text(title: Column | str, label: Column | str, article_title: Column | str, text: Column | str) -> Column:
    """Title, label and, if any, the article's title by lines; an empty line; the text."""
    return F.concat(F.array_join(F.array_compact(F.array(col(title), col(label), col(article_title))), "\n"), F.lit("\n\n"), col(text))


def fold(c: Column | str) -> Column:
    """Turkish-aware lower case over composed letters."""
    out = col(c)
    for pair, one in COMPOSED:
        out = F.replace(out, F.lit(pair), F.lit(one))
    for upper, one in (("I", "ı"), ("İ", "i")):  # several times as fast as translate(), which goes by characters
        out = F.replace(out, F.lit(upper), F.lit(one))
    return F.lower(out)


def tokens(c: Column | str, letters_only: bool = False) -> Column:
    """Folded words of letters and digits."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}]+)" if letters_only else r"([\p{L}\p{N}]+)"), F.lit(1))


def question_key(c: Column | str) -> Column:
    """By which questions are the same: white space collapsed, case ignored."""
    return F.lower(F.regexp_replace(strip(c), r"(?U)\s+", " "))


def snippet(text: Column | str, phrase: Column | str, size: int) -> Column:
    """size characters around the first hit, with ellipses where cut; the beginning where there is no hit."""
    t, p = col(text), col(phrase)
    at = F.greatest(F.position(p, t), F.lit(1))
    start = F.greatest(at - F.lit(size // 2), F.lit(1))
    end = start + F.lit(size)
    return F.concat(F.when(start > 1, "...").otherwise(""), F.substring(t, start, F.lit(size)), F.when(end <= F.length(t), "...").otherwise(""))


def detect(c: Column | str, numbers: list[str]) -> Column:
    """Sorted distinct standalone numbers of a list."""
    pattern = r"(?U)(?<!\w)(" + "|".join(numbers) + r")(?!\w)"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(1))))


def whitespace_hash(c: Column | str) -> Column:
    """SHA-256 of the text with white space collapsed."""
    return F.sha2(F.regexp_replace(strip(c), r"(?U)\s+", " ").cast("binary"), 256)


@functools.cache
def not_composed() -> str:
    """A pattern of the characters that composition (NFC) may change: marks (also those that Java doesn't know yet), parts of Hangul syllables, and those that it replaces by themselves."""
    c = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c))])
    runs = np.split(c, np.flatnonzero(np.diff(c) > 1) + 1)
    first = min(0x300, int(c[0]))  # the first mark: what is before it, most letters, is told by one comparison
    return rf"[\x{{{first:X}}}-\x{{10FFFF}}&&[\p{{M}}\x{{1161}}-\x{{1175}}\x{{11A8}}-\x{{11C2}}" + "".join(f"\\x{{{r[0]:X}}}-\\x{{{r[-1]:X}}}" for r in runs) + "]]"


def composed(df: DataFrame, c: str) -> DataFrame:
    """df with column c composed (NFC). Rows that may change are the only ones that leave the JVM."""
    may = F.coalesce(F.col(c).rlike(not_composed()), F.lit(False))

    def run(batches):
        for b in batches:
            b[c] = [unicodedata.normalize("NFC", t) for t in b[c]]
            yield b

    return df.where(~may).union(df.where(may).mapInPandas(run, df.schema))
