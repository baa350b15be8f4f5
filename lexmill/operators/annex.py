"""Annex units: contributors of one annex, their relation, canonical member, rendering and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import checks
from lexmill.functions import text as T

_LETTER = "[A-Za-zÇĞİÖŞÜçğıöşü]"
#: Digits of an annex's number (the reference's); collections with more annexes say so.
DIGITS = 3


def label(digits: int = DIGITS) -> str:
    """Pattern of labels: EK-77, EK 77/A, EK-77-A, EK 77 A."""
    return rf"(?iuU)\bEK\s*[-–—]?\s*(\d{{1,{digits}}})(?:(?:\s*[/–—-]\s*|\s+)({_LETTER}))?\b"


def heading(digits: int = DIGITS) -> str:
    """Pattern of headings: a label as a line of its own, maybe quoted."""
    return rf"(?iuU)^\s*[(\"“]?\s*EK\s*[-–—]?\s*\d{{1,{digits}}}(?:\s*[/–—-]\s*{_LETTER})?\s*[\"”]?\s*$"


#: What tells versions of one text (fixed values).
VERSION_MARKS = ("version", "eski metin", "yeni metin", "yürürlük tarihi", "değişik")
SAME = ("SINGLE", "EXACT_DUPLICATE", "WHITESPACE_EQUIVALENT", "STRUCTURALLY_EQUIVALENT")


def _key(text: Column, digits: int) -> Column:
    """n or n/X of the first label; null without one; annex 0 raises."""
    n, sub = F.regexp_extract(text, label(digits), 1), F.regexp_extract(text, label(digits), 2)
    number = F.when(n.cast("long") > 0, n.cast("long").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not an annex number: "), n)).cast("string"))
    return F.when(n != "", F.concat(number, F.when(sub != "", F.concat(F.lit("/"), F.upper(sub))).otherwise("")))


def heading_key(text: Column, digits: int = DIGITS) -> Column:
    """n or n/X of a heading: a line that is a label and nothing else, or one of up to 120 characters that cites the gazette (RG-), wherever the label stands in it."""
    t = T.strip(text)
    return F.when(t.rlike(heading(digits)) | ((F.length(t) <= 120) & F.contains(F.upper(t), F.lit("RG-"))), _key(text, digits))


def member_key(member: Column, digits: int = DIGITS) -> Column:
    """n or n/X of a member's file name; null where it has none."""
    return _key(F.regexp_replace(F.element_at(F.split(member, "/"), -1), r"(?<=.)\.[^.]*$", ""), digits)


def cell_value(c: Column) -> Column:
    """A cell's value, or its formula and what was cached of it."""
    return F.coalesce(c["value"], F.concat(F.lit("="), c["formula"], F.lit(" ["), F.coalesce(c["cached_value"], F.lit("")), F.lit("]")))


def render(kind: Column, text: Column, rows: Column, sheet: Column, cells: Column) -> Column:
    """A block as text: the paragraph, TABLE lines, or the SHEET's cells."""
    table = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("TABLE | "), F.array_join(r, " | "))), "\n")
    one = lambda c: F.concat(c["coord"], F.lit("="), cell_value(c))
    return F.when(kind == "table", table).when(kind == "spreadsheet", F.array_join(F.concat(F.array(F.concat(F.lit("SHEET | "), sheet)), F.transform(cells, one)), "\n")).otherwise(F.coalesce(text, F.lit("")))


def segments(blocks: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Adds annex and part: a member's first part is its file name's annex's, and a heading of another annex than the one before begins the next.

    An annex that comes back is a part of its own. A member whose name has no label raises. Windows are over the blocks of one file.
    digits: the most that an annex's number has, 1 to 18.
    """
    checks.one_of("digits", digits, tuple(range(1, 19)))
    w = Window.partitionBy("path", "member").orderBy("source_order")
    own = member_key(F.col("member"), digits)
    none = F.raise_error(F.concat(F.lit("no annex label in "), F.col("member"))).cast("string")
    here = F.when(F.col("kind") == "paragraph", heading_key(F.col("text"), digits))
    b = blocks.withColumn("own", F.when(own.isNull(), none).otherwise(own)).withColumn("here", here)
    b = b.withColumn("annex", F.coalesce(F.last("here", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "own"))
    new = F.col("annex") != F.coalesce(F.lag("annex").over(w), F.col("own"))
    return b.withColumn("new", new.cast("int")).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new", "here")


def _parts(blocks: DataFrame, digits: int, *cols: str) -> DataFrame:
    """A row for each part of a member: path, member, member_order, part, annex, detected, warning, blocks (source_order and cols, in order). The file name's own part is there even if nothing stands in it.

    All of it is by file, so blocks are shuffled once.
    """
    b = segments(blocks if "member_order" in blocks.columns else blocks.withColumn("member_order", F.lit(0)), digits)
    warning = F.max("warning") if "warning" in blocks.columns else F.lit(None).cast("string")
    made = b.groupBy("path", "member", "part", "annex").agg(F.array_sort(F.collect_list(F.struct("source_order", *cols))).alias("blocks"), F.min("own").alias("own"), F.min("member_order").alias("member_order"), F.min("detected").alias("detected"), warning.alias("warning"))
    of = Window.partitionBy("path", "member")
    file = [f(c).over(of).alias(c) for c, f in (("member_order", F.min), ("detected", F.min), ("warning", F.max))]
    made = made.select("path", "member", "part", "annex", "own", *file, "blocks", F.min("part").over(of).alias("least"))
    no, yes = F.lit(False), F.lit(True)
    made = made.withColumn("bare", F.explode(F.when((F.col("part") > 0) & (F.col("part") == F.col("least")), F.array(no, yes)).otherwise(F.array(no))))
    of_own = lambda own, c: F.when(F.col("bare"), own).otherwise(F.col(c)).alias(c)
    return made.select("path", "member", "member_order", of_own(F.lit(0), "part"), of_own(F.col("own"), "annex"), "detected", "warning", of_own(F.slice("blocks", 1, 0), "blocks"))


def contributors(blocks: DataFrame, digits: int = DIGITS) -> DataFrame:
    """A row for each part of a member: path, member, member_order, part, annex, detected, warning, text (its blocks rendered, by lines). The file name's own part is there even if nothing stands in it."""
    p = _parts(blocks.withColumn("r", render(F.col("kind"), F.col("text"), F.col("rows"), F.col("sheet_name"), F.col("cells"))), digits, "r")
    return p.select(*p.columns[:-1], _by_lines(F.transform("blocks", lambda x: x["r"])).alias("text"))


def _by_lines(texts: Column) -> Column:
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def relation(texts: Column) -> Column:
    """How an annex's contributors go together, by their texts: SINGLE, EXACT_DUPLICATE, WHITESPACE_EQUIVALENT,
    STRUCTURALLY_EQUIVALENT (each holds another or is held by one, case aside), CONFLICTING (two with version marks and
    none repealed), COMPLEMENTARY (all have text) or UNKNOWN."""
    return _relation(texts, F.transform(texts, _loose), F.transform(texts, T.fold))


def _loose(t: Column) -> Column:
    return F.regexp_replace(T.strip(t), r"(?U)\s+", " ")


def _relation(texts: Column, loose: Column, low: Column) -> Column:
    held = F.forall(low, lambda t: (t != "") & F.exists(low, lambda o: (o != t) & (o.contains(t) | t.contains(o))))
    marked = F.size(F.filter(low, lambda t: F.greatest(*(F.instr(t, m) for m in VERSION_MARKS)) > 0))
    return (
        F.when(F.size(texts) == 1, "SINGLE")
        .when(F.size(F.array_distinct(texts)) == 1, "EXACT_DUPLICATE")
        .when(F.size(F.array_distinct(loose)) == 1, "WHITESPACE_EQUIVALENT")
        .when(held, "STRUCTURALLY_EQUIVALENT")
        .when((marked >= 2) & ~F.exists(low, lambda t: t.contains("mülga")), "CONFLICTING")
        .when(F.forall(texts, lambda t: t != ""), "COMPLEMENTARY")
        .otherwise("UNKNOWN")
    )


def _gathered(parts: DataFrame, digits: int, text: Callable[[Column], Column], *cols: str) -> DataFrame:
    """contributors by annex: path, annex, s (member, part, warning and cols of each, in archive order), texts, relation, c (m and p: the canonical one's member and part). text: of one's cols."""
    dedicated = member_key(F.col("member"), digits) == F.col("annex")
    place = F.struct((~dedicated).alias("a"), (~F.col("detected").isin("docx", "xlsx")).alias("b"), F.col("member").alias("m"), F.col("part").alias("p"))
    at = F.struct("member_order", "member", "part")
    g = parts.groupBy("path", "annex").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "member", "part", "warning", *cols))).alias("s"), F.min(place).alias("c"))
    g = g.withColumn("texts", F.transform("s", text)).withColumn("several", F.size(F.array_distinct("texts")) > 1)
    g = g.withColumn("loose", F.when(F.col("several"), F.transform("texts", _loose))).withColumn("low", F.when(F.col("several"), F.transform("texts", T.fold)))  # once a text: the relation asks for them again and again
    return g.withColumn("relation", _relation(F.col("texts"), F.col("loose"), F.col("low"))).drop("several", "loose", "low")


def _header(member: Column) -> Column:
    return F.concat(F.lit("SOURCE_MEMBER | "), member, F.lit("\n"))


def _rendered(s: Column, texts: Column, relation: Column, member: Column, part: Column) -> Column:
    """The canonical contributor's text, or all of them one after another under headers, those without text left out."""
    each = F.zip_with(s, texts, lambda x, t: F.struct(x["member"].alias("member"), x["part"].alias("part"), t.alias("text")))
    joined = F.array_join(F.transform(F.filter(each, lambda x: x["text"] != ""), lambda x: F.concat(_header(x["member"]), x["text"])), "\n")
    return F.when(relation.isin(*SAME), F.filter(each, lambda x: (x["member"] == member) & (x["part"] == part))[0]["text"]).otherwise(joined)


def units(blocks: DataFrame, digits: int = DIGITS) -> DataFrame:
    """path, annex, members (of its contributors, in archive order), relation, canonical (member, part), rendered, warnings.

    Duplicates are rendered as the canonical contributor (one whose file name is this annex's first, then docx and xlsx, then by
    name); others one after another in archive order with headers, those without text left out.
    """
    g = _gathered(contributors(blocks, digits), digits, lambda x: x["text"], "text")
    rendered = _rendered(F.col("s"), F.col("texts"), F.col("relation"), F.col("c.m"), F.col("c.p"))
    return g.select("path", "annex", F.transform("s", lambda x: x["member"]).alias("members"), "relation", F.col("c.m").alias("canonical"), F.col("c.p").alias("canonical_part"), rendered.alias("rendered"), F.array_distinct(F.array_compact(F.transform("s", lambda x: x["warning"]))).alias("warnings"))


def diagnostics(blocks: DataFrame, made: DataFrame) -> DataFrame:
    """A row an archive, over units(): members, units, multi_source (annexes of several contributors), empty (units without text), unresolved, failures (units
    with warnings), unreadable (whose warning says that nothing could be read), storage_collisions (storage ids of several annexes), readers (members by how they were read), provenance (every member
    has its own and the archive's hash) and normalization (every member in a legacy format was converted)."""
    has = lambda c: F.col(c) if c in blocks.columns else F.lit(None).cast("string")
    one = blocks.groupBy("path", "member").agg(F.first("detected").alias("detected"), F.max(has("member_sha256")).alias("sha"), F.max(has("archive_sha256")).alias("zip"), F.max(has("normalized")).alias("normalized"), F.max(has("original")).alias("original"))
    reader = F.when(F.col("normalized").isNotNull(), F.concat(F.lit("normalized_"), F.col("detected"))).when(F.col("detected") == "ole", F.when(F.lower("member").endswith(".xls"), "legacy_xls").otherwise("legacy_doc")).otherwise(F.col("detected"))
    counts = one.groupBy("path", reader.alias("reader")).agg(F.count("*").alias("n"), F.count_if(F.col("sha").isNull() | F.col("zip").isNull()).alias("bare"), F.count_if((F.coalesce("original", "detected") == "ole") & F.col("normalized").isNull()).alias("legacy"))
    read = counts.groupBy("path").agg(F.sum("n").alias("members"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reader", "n")))).alias("readers"), (F.sum("bare") == 0).alias("provenance"), (F.sum("legacy") == 0).alias("normalization"))
    storage = F.lower(F.regexp_replace("annex", "/", "-"))
    clash = made.groupBy("path", storage.alias("s")).count().groupBy("path").agg(F.count_if(F.col("count") > 1).alias("storage_collisions"))
    of = made.groupBy("path").agg(F.count("*").alias("units"), F.count_if(F.size("members") > 1).alias("multi_source"), F.count_if(F.col("rendered") == "").alias("empty"), F.count_if(F.col("relation").isin("CONFLICTING", "UNKNOWN")).alias("unresolved"), F.count_if(F.size("warnings") > 0).alias("failures"), F.count_if(F.exists("warnings", lambda w: w.contains("can't read"))).alias("unreadable"))
    return read.join(of, "path").join(clash, "path")


def resolved(made: DataFrame) -> DataFrame:
    """made, or an error where contributors are unresolved or an annex is there twice."""
    bad = F.col("relation").isin("CONFLICTING", "UNKNOWN")
    m = made.withColumn("n", F.count("*").over(Window.partitionBy("path", "annex")))
    text = F.when(bad, F.raise_error(F.concat(F.lit("unresolved contributors of annex "), F.col("annex"))).cast("string")).when(F.col("n") > 1, F.raise_error(F.concat(F.lit("annex twice: "), F.col("annex"))).cast("string")).otherwise(F.col("rendered"))
    return m.withColumn("rendered", text).drop("n")


_PIECES = "array<struct<piece:int,t:string,first:bigint,last:bigint,coordinates:array<string>>>"


def fragments(blocks: DataFrame, limit: int) -> DataFrame:
    """blocks + pieces, those of a block that aren't cut, in order: piece (from 0), t, first and last (exclusive) row or cell, coordinates.

    A table's rows; a sheet's rows of cells, its cells one by one where a row passes limit; the lines of a paragraph that passes limit (chunks() says at which
    characters); other blocks whole; none of a block without kind. Pieces joined without anything between are the rendered block, or an error is raised: line ends belong to the piece that follows.
    """
    keys = ["path", "member", "source_order"]
    none, nowhere = F.lit(None).cast("long"), F.lit(None).cast("array<string>")
    k, whole = F.col("kind"), F.coalesce(render(F.col("kind"), F.col("text"), F.col("rows"), F.col("sheet_name"), F.col("cells")), F.lit(""))
    yes = lambda c: F.coalesce(c, F.lit(False))
    line = lambda i: F.when(i > 0, "\n").otherwise("")
    is_table, is_sheet = yes((k == "table") & (F.size("rows") > 0)), yes((k == "spreadsheet") & (F.size("cells") > 0))
    by_line = yes((k == "paragraph") & (F.length("text") > limit) & F.contains("text", F.lit("\n")))
    rows = F.transform("rows", lambda r, i: F.struct(i, F.concat(line(i), F.lit("TABLE | "), F.array_join(r, " | ")), i.cast("long"), i.cast("long") + 1, nowhere)).cast(_PIECES)
    lines = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(i, F.concat(line(i), t), none, none, nowhere)).cast(_PIECES)
    differ = F.raise_error(F.concat(F.lit("pieces differ from the rendered block of "), F.col("member"))).cast(_PIECES)
    checked = lambda p: F.when(F.array_join(F.transform(p, lambda x: x["t"]), "") == whole, p).otherwise(differ)
    one = F.array(F.struct(F.lit(0), whole, none, none, nowhere)).cast(_PIECES)
    plain = blocks.where(~is_sheet).withColumn("pieces", F.when(k.isNull(), F.array().cast(_PIECES)).when(is_table, checked(rows)).when(by_line, checked(lines)).otherwise(one))
    w = Window.partitionBy(*keys).orderBy("i")
    cells = blocks.where(is_sheet).select(*keys, "sheet_name", F.posexplode("cells").alias("i", "c")).withColumn("row", F.nullif(F.regexp_extract("c.coord", "^[A-Za-z]+([0-9]+)$", 1), F.lit("")))
    cells = cells.withColumn("t", F.concat("c.coord", F.lit("="), cell_value(F.col("c")))).withColumn("head", F.when(F.col("i") == 0, F.concat(F.lit("SHEET | "), "sheet_name", F.lit("\n"))).otherwise("\n"))
    same = F.col("row").isNotNull() & F.coalesce(F.lag("row").over(w) == F.col("row"), F.lit(False))
    cells = cells.withColumn("same", same).withColumn("g", F.sum((~F.col("same")).cast("int")).over(w))
    of = Window.partitionBy(*keys, "g")
    over = F.sum(F.length("t") + 1).over(of) + F.max(F.when(F.col("i") == 0, F.length("head")).otherwise(0)).over(of) > limit
    cells = cells.withColumn("g2", F.when(over, F.col("i")).otherwise(F.min("i").over(of)))
    joined = F.array_sort(F.collect_list(F.struct("i", "t", "head", F.col("c.coord").alias("coord"))))
    sheets = cells.groupBy(*keys, "g2").agg(joined.alias("s")).select(*keys, F.struct(F.col("g2"), F.concat(F.col("s")[0]["head"], F.array_join(F.transform("s", lambda x: x["t"]), "\n")), F.col("g2").cast("long"), F.col("g2").cast("long") + F.size("s"), F.transform("s", lambda x: x["coord"])).alias("p"))
    sheets = blocks.where(is_sheet).join(sheets.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).cast(_PIECES).alias("p")), keys)
    return plain.unionByName(sheets.withColumn("pieces", checked(F.col("p"))).drop("p"))


#: Pieces that a fold appends to one array: what it copies at each step.
_STEP = 128


def _packed(sizes: Column, limit: int) -> Column:
    """sizes (array of structs: size and bare, with and without what joins pieces) -> for each piece: new (a chunk begins, other than the first) and before (the characters ahead of it, bare).

    A chunk begins where a piece would take the open one over limit, unless that has no text yet. A fold over blocks of _STEP pieces, so that what is copied grows with their number and not with its square.
    """
    kind = "struct<size:bigint,chars:bigint,out:array<{0}struct<new:boolean,before:bigint>{1}>>"
    start = lambda size, chars, many: F.struct(size, chars, F.array()).cast(kind.format(*(("array<", ">") if many else ("", ""))))

    def step(z: Column, x: Column) -> Column:
        over = (z["size"] > 0) & (z["size"] + x["size"] > limit)
        return F.struct(F.when(over, x["size"]).otherwise(z["size"] + x["size"]).alias("size"), (z["chars"] + x["bare"]).alias("chars"), F.concat(z["out"], F.array(F.struct(over.alias("new"), z["chars"].alias("before")))).alias("out"))

    def block(a: Column, x: Column) -> Column:
        return F.aggregate(x, start(a["size"], a["chars"], False), step, lambda z: F.struct(z["size"].alias("size"), z["chars"].alias("chars"), F.concat(a["out"], F.array(z["out"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _STEP).cast("int")), lambda k: F.slice(sizes, k * _STEP + 1, F.lit(_STEP)))
    return F.when(F.size(sizes) > 0, F.flatten(F.aggregate(blocks, start(F.lit(0), F.lit(0), True), block, lambda a: a["out"])))


def chunks(blocks: DataFrame, limit: int = 4000, document_id: str = "document", made: DataFrame | None = None, digits: int = DIGITS, unresolved: str = "raise") -> DataFrame:
    """blocks -> path, annex, chunk_no (from 1), chunk_id, member, text, char_start, char_end, oversized, pieces (source_order, kind, first, last, sheet_name, coordinates), oversized_pieces.

    Pieces (fragments) of each unit's contributors packed in order, never over limit but where one piece is; a contributor begins a chunk, with its
    SOURCE_MEMBER line if they are rendered one after another. A unit's chunks joined without anything between are its rendered text, or
    an error is raised; so it is where contributors are unresolved (unresolved="drop" leaves those units out) or limit isn't positive. A unit without blocks is one empty chunk.
    made: of units(blocks, digits), those to chunk; else all.
    Blocks are shuffled once by file and once by annex, with their text in pieces alone; a unit is a row until it is cut, as it is in units().
    """
    checks.positive("limit", limit), checks.one_of("unresolved", unresolved, ("raise", "drop"))
    parts = _parts(fragments(blocks, limit), digits, "kind", "sheet_name", "pieces")
    g = _gathered(parts, digits, lambda x: _by_lines(F.transform(x["blocks"], lambda b: F.array_join(F.transform(b["pieces"], lambda p: p["t"]), ""))), "blocks")
    bad = F.col("relation").isin("CONFLICTING", "UNKNOWN")
    differs = lambda kind: F.raise_error(F.concat(F.lit("chunks differ from the rendered annex "), F.col("annex"))).cast(kind)
    if made is not None:
        m = resolved(made.where(~bad) if unresolved == "drop" else made).select("path", "annex", "relation", F.struct(F.col("canonical").alias("m"), F.col("canonical_part").alias("p")).alias("c"), "rendered")
        g = m.join(g.drop("relation", "c"), ["path", "annex"], "left")
        ours = F.coalesce(_rendered(F.col("s"), F.col("texts"), F.col("relation"), F.col("c.m"), F.col("c.p")), F.lit(""))
        g = g.withColumn("relation", F.when(ours == F.col("rendered"), F.col("relation")).otherwise(differs("string"))).drop("rendered")
    elif unresolved == "drop":
        g = g.where(~bad)
    else:
        g = g.withColumn("relation", F.when(bad, F.raise_error(F.concat(F.lit("unresolved contributors of annex "), F.col("annex"))).cast("string")).otherwise(F.col("relation")))
    g = g.withColumn("same", F.col("relation").isin(*SAME))
    own = lambda x: ~F.col("same") | ((x["member"] == F.col("c.m")) & (x["part"] == F.col("c.p")))
    each = F.zip_with("s", "texts", lambda x, t: F.struct(x["member"].alias("member"), x["part"].alias("part"), F.filter(x["blocks"], lambda b: F.size(b["pieces"]) > 0).alias("blocks"), t.alias("text")))
    g = g.withColumn("use", F.filter(each, lambda x: own(x) & (F.size(x["blocks"]) > 0)))
    g = g.withColumn("with_text", F.array_position(F.transform("use", lambda x: x["text"] != ""), True))
    # line ends before blocks, headers before contributors: at the first piece with text of each
    g = g.select("path", "annex", "same", F.col("c.m").alias("owner"), "with_text", F.posexplode_outer("use").alias("section", "x"))
    g = g.select("path", "annex", "owner", "section", "x.*", F.when(~F.col("same"), F.concat(F.when((F.col("with_text") > 0) & (F.col("section") >= F.col("with_text")), "\n").otherwise(""), _header(F.col("x.member")))).otherwise("").alias("header"))
    g = g.withColumn("filled", F.transform("blocks", lambda b: F.exists(b["pieces"], lambda p: p["t"] != ""))).withColumn("block", F.array_position("filled", True) - 1)
    g = g.withColumn("first_piece", F.array_position(F.transform(F.get("blocks", F.col("block").cast("int"))["pieces"], lambda p: p["t"] != ""), True) - 1)

    def piece(b: Column, j: Column) -> Column:
        before = lambda i: F.when((j == F.col("block")) & (i == F.col("first_piece")), F.col("header")).when((i == 0) & (F.col("block") >= 0) & (j > F.col("block")) & F.get("filled", j), "\n").otherwise("")
        lines = (b["kind"] == "paragraph") & (F.size(b["pieces"]) > 1)
        return F.transform(b["pieces"], lambda p, i: F.struct(b["source_order"].alias("source_order"), b["kind"].alias("kind"), p["first"].alias("first"), p["last"].alias("last"), b["sheet_name"].alias("sheet_name"), p["coordinates"].alias("coordinates"), F.when(lines, i).alias("line"), F.length(p["t"]).alias("bare"), F.concat(before(i), p["t"]).alias("t")))

    g = g.withColumn("all", F.flatten(F.transform("blocks", piece))).drop("blocks", "filled")
    right = F.array_join(F.transform("all", lambda p: p["t"]), "") == F.concat(F.when(F.col("text") != "", F.col("header")).otherwise(""), F.col("text"))
    g = g.withColumn("text", F.when(F.coalesce(right, F.col("all").isNull()), F.lit("")).otherwise(differs("string")))
    g = g.withColumn("sizes", F.transform("all", lambda p: F.struct(F.length(p["t"]).cast("long").alias("size"), p["bare"].cast("long").alias("bare"))))
    g = g.withColumn("cut", _packed(F.col("sizes"), limit)).drop("sizes")

    def placed(p: Column, i: Column) -> Column:
        begun = F.get("cut", i)["before"] - F.get("cut", i - p["line"])["before"]
        first, last = F.coalesce(begun, p["first"]), F.coalesce(begun + p["bare"], p["last"])
        return F.struct(F.struct(p["source_order"].alias("source_order"), p["kind"].alias("kind"), first.alias("first"), last.alias("last"), p["sheet_name"].alias("sheet_name"), p["coordinates"].alias("coordinates")).alias("at"), p["t"].alias("t"))

    g = g.withColumn("all", F.transform("all", placed)).withColumn("starts", F.array_compact(F.transform("cut", lambda x, i: F.when(x["new"] | (i == 0), i))))
    of = F.transform("starts", lambda a, k: F.slice("all", a + 1, F.coalesce(F.get("starts", k + 1), F.size("all")) - a))
    g = g.select("path", "annex", "section", F.coalesce("member", "owner").alias("member"), "text", F.posexplode_outer(of).alias("batch", "s"))
    g = g.select("path", "annex", "section", "batch", "member", F.concat("text", F.coalesce(F.array_join(F.transform("s", lambda x: x["t"]), ""), F.lit(""))).alias("text"), F.transform("s", lambda x: x["at"]).alias("pieces"), F.transform(F.filter("s", lambda x: x["t"] != ""), lambda x: x["at"]).alias("full"))
    w = Window.partitionBy("path", "annex").orderBy("section", "batch")
    n = F.length("text")
    end = F.sum(n).over(w)
    out = g.withColumn("chunk_no", F.row_number().over(w)).withColumn("char_end", end).withColumn("char_start", F.col("char_end") - n)
    reason = F.when(n > limit, F.transform("full", lambda x: F.struct(F.when(x["kind"] == "table", "table_row").when(x["kind"] == "spreadsheet", "spreadsheet_cell_or_row").otherwise("paragraph").alias("reason"), n.alias("chars"), x["source_order"].alias("source_order"))))
    ident = F.format_string("%s-ek-%s-chunk-%03d", F.lit(document_id), F.lower(F.regexp_replace("annex", "/", "-")), "chunk_no")
    return out.select("path", "annex", "chunk_no", ident.alias("chunk_id"), "member", "text", "char_start", "char_end", (n > limit).alias("oversized"), "pieces", reason.alias("oversized_pieces"))
