"""Structured legal text: paragraphs to articles, by windows over paragraphs in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T

#: Ordinals and levels of headings (fixed values of the language).
ORDINALS = ("BİRİNCİ", "İKİNCİ", "ÜÇÜNCÜ", "DÖRDÜNCÜ", "BEŞİNCİ", "ALTINCI", "YEDİNCİ", "SEKİZİNCİ", "DOKUZUNCU", "ONUNCU", "ONBİRİNCİ", "ONİKİNCİ", "ONÜÇÜNCÜ")
SECTIONS = ("KİTAP", "KISIM", "BÖLÜM", "AYIRIM")
_NO, _PLAIN = r"(\d+(?:\s*/\s*[A-ZÇĞİÖŞÜa-zçğıöşü])?)", r"(\d+)"
EK, GECICI, MADDE = (r"(?iuU)^\s*" + head + r"\s+" + no + r"\s*[-–—]" for head, no in (("EK\\s+MADDE", _PLAIN), ("GEÇİCİ\\s+MADDE", _PLAIN), ("MADDE", _NO)))
#: How letters are spelt in ids, and what each article type is called there (fixed values).
SPELT = (("Ç", "c-cedilla"), ("Ğ", "g-breve"), ("İ", "i-dotted"), ("Ö", "o-umlaut"), ("Ş", "s-cedilla"), ("Ü", "u-umlaut"))
PREFIXES = {"normal": "madde", "ek": "ek-madde", "gecici": "gecici-madde", "islenemeyen_hukum": "islenemeyen-hukum-gecici-madde"}
HISTORY = r"(?iuU)^\d+\s+SAYILI\s+KANUNA\s+EK\s+VE\s+DEĞİŞİKLİK"
SPECIAL = r"(?U)^\d+\s+SAYILI\s+KANUNA\s+İŞLENEMEYEN\s+HÜKÜMLER$"
SECTION = r"(?U)^\s*(" + "|".join(ORDINALS) + r")\s+(" + "|".join(SECTIONS) + r")\s*$"


def heading_type(c: Column) -> Column:
    return F.when(c.rlike(EK), "ek").when(c.rlike(GECICI), "gecici").when(c.rlike(MADDE), "normal")


def heading_number(c: Column) -> Column:
    n = F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (EK, GECICI, MADDE)))
    return F.upper(F.translate(F.regexp_replace(n, r"(?U)\s", ""), "iı", "İI"))  # i is upper-cased with its dot


def is_title(c: Column) -> Column:
    """Short, no closing mark, not a heading, number, letter or marker."""
    t = T.strip(c)
    other = heading_type(t).isNotNull() | t.rlike(SECTION) | t.rlike(r"(?U)^\(\d+\)\s") | t.rlike(r"(?U)^\d+\.") | t.rlike(r"(?U)^\p{L}\)\s") | t.rlike(HISTORY) | t.rlike(SPECIAL)
    return (F.length(t) > 0) & (F.length(t) <= 80) & ~t.rlike(r"[.:;]$") & ~t.startswith("(") & ~other


def _title_case(c: Column) -> Column:
    """BİRİNCİ KISIM to Birinci Kısım."""
    low = F.transform(F.split(c, " "), lambda w: F.concat(F.substring(w, 1, 1), T.fold(F.substring(w, 2, 100))))
    return F.array_join(low, " ")


def articles(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(document_id, index, text, footnotes array<int>) -> articles in order.

    One ordered pass, told by windows over a document: a history marker ends it; a marker of provisions that
    weren't worked in begins a special part, in which temporary articles have a type of their own and their
    title is the last line before any article there; a section heading ends the article and resets lower
    levels; an article heading opens one, titled by the line just before if that looks like a title, which
    then isn't part of the previous article's text. Paragraphs before the first article, and those between
    a section heading and the next article, belong to none.
    """
    doc = Window.partitionBy("document_id").orderBy("index")
    upto, ahead = doc.rowsBetween(Window.unboundedPreceding, 0), doc.rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("text")
    p = paragraphs.withColumn("stop", F.max(t.rlike(HISTORY).cast("int")).over(upto)).where("stop = 0").drop("stop")
    p = p.withColumn("special_here", T.strip(t).rlike(SPECIAL)).withColumn("section", F.regexp_extract(t, SECTION, 2)).withColumn("type", F.when(~F.col("special_here") & (F.col("section") == ""), heading_type(t)))
    p = p.withColumn("special", F.max(F.col("special_here").cast("int")).over(upto) == 1)
    p = p.withColumn("closes", F.col("special_here") | (F.col("section") != "") | F.col("type").isNotNull()).withColumn("part", F.sum(F.col("closes").cast("int")).over(upto))
    p = p.withColumn("previous", F.lag("text").over(doc)).withColumn("previous_notes", F.lag("footnotes").over(doc)).withColumn("next_type", F.lead("type").over(doc))
    p = p.withColumn("opened", F.max(F.when(F.col("special"), F.col("type").isNotNull().cast("int"))).over(Window.partitionBy("document_id", "part").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)))
    preamble = F.when(F.col("special") & ~F.col("special_here") & (F.col("section") == "") & F.col("type").isNull() & (F.coalesce("opened", F.lit(0)) == 0), t)
    p = p.withColumn("preamble", F.last(preamble, ignorenulls=True).over(ahead))
    level = {s: F.struct(F.col("index").alias("at"), _title_case(t).alias("name")) for s in SECTIONS}
    for k, s in enumerate(SECTIONS):
        own = F.when(F.col("section") == s, level[s])
        if s == "AYIRIM":
            own = F.coalesce(own, F.when(F.col("special_here"), F.struct(F.col("index").alias("at"), t.alias("name"))))
        reset = F.max(F.when(F.col("section").isin(*SECTIONS[:k]) | F.col("special_here") & F.lit(s != "AYIRIM"), F.col("index"))).over(upto)
        last = F.last(own, ignorenulls=True).over(upto)
        p = p.withColumn(f"l{k}", F.when(reset.isNull() | (last["at"] >= reset), last["name"]))
    kind = F.when(F.col("special") & (F.col("type") == "gecici"), "islenemeyen_hukum").otherwise(F.col("type"))
    title = F.when(kind == "islenemeyen_hukum", F.col("preamble")).when(is_title(F.col("previous")), F.col("previous"))
    heads = p.where("type is not null").select("document_id", "part", F.col("index").alias("first"), kind.alias("article_type"), heading_number(t).alias("article_no"), title.alias("article_title"), T.section_context("l0", "l1", "l2", "l3").alias("section_context"), T.amendment_note(F.regexp_replace(t, "|".join(f"(?:{x})" for x in (EK, GECICI, MADDE)), "")).alias("amendment_note"), F.when(title.isNotNull() & (kind != "islenemeyen_hukum"), F.col("previous_notes")).alias("title_notes"))
    body = p.where(~(is_title(t) & F.col("next_type").isNotNull()) | F.col("type").isNotNull())
    parts = body.groupBy("document_id", "part").agg(F.array_sort(F.collect_list(F.struct("index", "text", "footnotes"))).alias("s"))
    out = heads.join(parts, ["document_id", "part"])
    notes = F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.concat(F.array("title_notes"), F.transform("s", lambda x: x["footnotes"]))))))
    slug = F.translate("article_no", "/", "-")
    for letter, name in SPELT:
        slug = F.replace(slug, F.lit(letter), F.lit(name))
    prefix = F.element_at(F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv)), F.col("article_type"))
    name = F.coalesce("legislation_number", "document_id") if "legislation_number" in paragraphs.columns else F.col("document_id")
    if "legislation_number" in paragraphs.columns:
        out = out.join(paragraphs.groupBy("document_id").agg(F.max("legislation_number").alias("legislation_number")), "document_id")
    return out.select("document_id", F.concat_ws("-", name, prefix, F.lower(slug)).alias("article_id"), "article_no", "article_type", "article_title", "section_context", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("text"), F.col("first").alias("start"), F.element_at("s", -1)["index"].alias("end"), "amendment_note", F.when(F.size(notes) > 0, notes).alias("footnotes"))
