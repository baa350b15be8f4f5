import hashlib
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import annex, sequences
from lexmill.sources import office
from tests.test_operators import docx

BLOCK = "path string, member string, member_order int, detected string, source_order int, kind string, text string, rows array<array<string>>, sheet_name string, cells array<struct<coord:string,value:string,formula:string,cached_value:string>>, warning string"


def blocks(spark, *members):
    """members: (name, blocks), each block a text, rows, or (sheet, cells)."""
    out = []
    for order, (name, made) in enumerate(members):
        for k, b in enumerate(made or [None]):
            kind = None if b is None else "paragraph" if isinstance(b, str) else "table" if isinstance(b, list) else "spreadsheet"
            out.append(("z", name, order, "docx", k, kind, b if kind == "paragraph" else None, b if kind == "table" else None, b[0] if kind == "spreadsheet" else None, b[1] if kind == "spreadsheet" else None, None))
    return spark.createDataFrame(out, BLOCK).repartition(3)


def chunked(spark, limit, *members, **how):
    c = annex.chunks(blocks(spark, *members), limit, **how).orderBy("annex", "chunk_no").collect()
    for a in {r.annex for r in c}:
        mine = [r for r in c if r.annex == a]
        assert [r.char_start for r in mine] == [0, *(r.char_end for r in mine[:-1])] and all(r.char_end - r.char_start == len(r.text) for r in mine)
    return c


@pytest.mark.parametrize(("line", "key"), [("EK-77", "77"), ("  ek 77/a ", "77/A"), ("EK–77-A", "77/A"), ("“EK-77/Ç”", "77/Ç"), ("(EK-77", "77"), ("EK-80 listesinde", None), ("EK-77 A", None), ("(Değişik:RG-1/1/2020-1) EK 77/A", "77/A"), ("(Değişik:RG-1) EK 77 A", "77/A"), ("RG-1 " + "x" * 120 + " EK-5", None), ("madde", None), ("EK-007", "7"), ("EK-1234", None)])
def test_headings(spark, line, key):
    assert spark.createDataFrame([(line,)], "t string").select(annex.heading_key(F.col("t"))).first()[0] == key


@pytest.mark.parametrize(("name", "key"), [("a/EK-77.docx", "77"), ("EK 77 A.docx", "77/A"), ("ek-9-b.docx", "9/B"), ("EK_77.docx", None), ("EK 48 kopya.docx", "48"), ("EK77.docx", "77"), ("liste.EK-3.xlsx", "3")])
def test_file_names(spark, name, key):
    assert spark.createDataFrame([(name,)], "t string").select(annex.member_key(F.col("t"))).first()[0] == key


def test_an_annex_that_comes_back_is_another_contributor(spark):
    b = blocks(spark, ("EK-1.docx", ["one", "EK-2", "two", "EK-1", "three"]), ("EK-5.docx", ["EK-6", "six"]), ("EK-9.docx", None))
    c = annex.contributors(b).orderBy("member_order", "part").collect()
    assert [(r.annex, r.part, r.text) for r in c] == [("1", 0, "one"), ("2", 1, "EK-2\ntwo"), ("1", 2, "EK-1\nthree"), ("5", 0, ""), ("6", 1, "EK-6\nsix"), ("9", 0, "")]
    u = {r.annex: r for r in annex.units(b).collect()}
    assert u["1"].relation == "COMPLEMENTARY" and u["1"].members == ["EK-1.docx"] * 2
    assert u["1"].rendered == "SOURCE_MEMBER | EK-1.docx\none\nSOURCE_MEMBER | EK-1.docx\nEK-1\nthree" and u["5"].rendered == u["9"].rendered == ""


def test_numbers_of_more_digits_where_the_collection_has_them(spark):
    b = blocks(spark, ("EK-1000 0.docx", ["one", "EK-1000/Z", "alt", "EK-1000", "back"]), ("EK-3000000000 1.docx", ["two"]))
    with pytest.raises(Exception, match="no annex label in EK-1000 0.docx"):
        annex.units(b).collect()
    u = {r.annex: r for r in annex.units(b, 10).collect()}
    assert sorted(u) == ["1000", "1000/Z", "3000000000"] and u["3000000000"].canonical == "EK-3000000000 1.docx"
    assert u["1000"].rendered == "SOURCE_MEMBER | EK-1000 0.docx\none\nSOURCE_MEMBER | EK-1000 0.docx\nEK-1000\nback"
    for bad in (0, 19, None):
        with pytest.raises(ValueError, match="digits"):
            annex.units(b, bad)


def test_chunks_of_annexes_with_more_digits(spark):
    c = chunked(spark, 4000, ("EK-1000 0.docx", ["one", "EK-1000/Z", "alt"]), digits=4)
    assert [(r.annex, r.text) for r in c] == [("1000", "one"), ("1000/Z", "EK-1000/Z\nalt")]


def test_contributors_stand_in_archive_order_and_warnings_are_kept(spark):
    b = blocks(spark, ("z EK-1.docx", ["last by name"]), ("a EK-1.docx", ["first by name"])).withColumn("warning", F.when(F.col("member_order") == 1, "w"))
    u = annex.units(b).first()
    assert u.rendered == "SOURCE_MEMBER | z EK-1.docx\nlast by name\nSOURCE_MEMBER | a EK-1.docx\nfirst by name" and u.warnings == ["w"] and u.canonical == "a EK-1.docx"


def test_large_pieces_keep_rows_cells_and_sheet(spark):
    c = chunked(spark, 4000, ("EK-62.docx", ["p" * 4001, [["a\nb", "", "c" * 4500], ["last", "cell", ""]], ("Sheet One", [("A1", "x" * 4100, None, None), ("B1", None, "SUM(A1)", "2")]), "end"]))
    assert sum(r.oversized for r in c) == 3 and all(r.oversized_pieces for r in c if r.oversized)
    assert [r.oversized_pieces[0].reason for r in c if r.oversized] == ["paragraph", "table_row", "spreadsheet_cell_or_row"]
    assert [r.chunk_id for r in c] == [f"document-ek-62-chunk-{k:03d}" for k in range(1, len(c) + 1)]


def test_soft_limit_and_empty_blocks(spark):
    c = chunked(spark, 4, ("EK-1.docx", ["", "abc", "", "def", ""]))
    assert [r.text for r in c] == ["abc", "\ndef"] and [[p.source_order for p in r.pieces] for r in c] == [[0, 1, 2], [3, 4]]
    assert [(r.text, r.pieces) for r in chunked(spark, 4, ("EK-1.docx", None))] == [("", None)]
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError, match="positive"):
            annex.chunks(blocks(spark, ("EK-1.docx", ["a"])), bad)


def test_tables_are_cut_between_rows_sheets_between_rows_or_cells(spark):
    rows = [[str(i), "legal\ntext" * 90, ""] for i in range(30)]
    c = chunked(spark, 4000, ("EK-1.docx", [rows]))
    assert len(c) > 1 and max(len(r.text) for r in c) <= 4000 and [p.first for r in c for p in r.pieces] == list(range(30))
    cells = [(f"{col}{row}", "v" * 1400, None, None) for row in range(1, 8) for col in "ABC"]
    c = chunked(spark, 4000, ("EK-1.docx", [("Legal sheet", cells)]))
    assert max(len(r.text) for r in c) <= 4000 and sum(r.text.count("SHEET | Legal sheet") for r in c) == 1 and len({p.first for r in c for p in r.pieces}) == 21
    small = [(f"{col}{row}", "v", None, None) for row in (1, 2, 1) for col in "AB"]
    c = chunked(spark, 30, ("EK-1.docx", [("S", small)]))
    assert [[(p.first, p.last) for p in r.pieces] for r in c] == [[(0, 2), (2, 4)], [(4, 6)]] and c[0].pieces[0].coordinates == ["A1", "B1"]


def test_long_paragraphs_are_cut_at_lines_short_ones_never(spark):
    text = "\n".join(["legal text " * 90] * 20)
    c = chunked(spark, 4000, ("EK-1.docx", ["\n\nshort\none", text, "\nx" + "y" * 4000]))
    assert len(c) > 1 and c[0].text.startswith("\n\nshort\none\nlegal") and "".join(r.text for r in c) == "\n\nshort\none\n" + text + "\n\nx" + "y" * 4000
    assert [len(r.pieces) for r in chunked(spark, 12, ("EK-1.docx", ["ab\ncd", "ef\ngh"]))] == [2]


def test_contributors_begin_chunks_with_their_header(spark):
    members = (("EK-33 bir.docx", ["bir iki", "üç"]), ("EK-33 iki.docx", ["", "dört"]), ("EK-33 son.docx", ["beş " * 20]))
    c = chunked(spark, 44, *members)
    assert [r.text for r in c[:2]] == ["SOURCE_MEMBER | EK-33 bir.docx\nbir iki\nüç", "\nSOURCE_MEMBER | EK-33 iki.docx\ndört"]
    assert [r.member for r in c] == ["EK-33 bir.docx", "EK-33 iki.docx", "EK-33 son.docx"] and sum("SOURCE_MEMBER | " in r.text for r in c) == 3


def test_what_is_unresolved_or_differs_raises(spark):
    b = blocks(spark, ("EK-1.docx", ["body"]), ("EK-2 bir.docx", ["Eski metin: x"]), ("EK-2 iki.docx", ["Yeni metin: y"]))
    made = annex.units(b)
    assert made.where("annex = '2'").first().relation == "CONFLICTING"
    with pytest.raises(Exception, match="unresolved contributors of annex 2"):
        annex.chunks(b).collect()
    one = made.where("annex = '1'")
    with pytest.raises(Exception, match="chunks differ"):
        annex.chunks(b.where("member = 'EK-1.docx'"), made=one.withColumn("rendered", F.lit("different"))).collect()
    with pytest.raises(Exception, match="annex twice"):
        annex.chunks(b.where("member = 'EK-1.docx'"), made=one.union(one)).collect()


def test_blocks_are_shuffled_once_by_file_and_once_by_annex(spark):
    b = blocks(spark, ("EK-33 bir.docx", ["bir iki", "üç"]), ("EK-33 iki.docx", ["dört"])).where("kind <> 'spreadsheet'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = annex.chunks(b, 44)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    by = [line.split("hashpartitioning(")[1].split(", ENSURE")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line and "source_order" not in line]
    assert len(by) == 2 and "annex" in by[0] and "member" in by[1] and "Python" not in plan and "Arrow" not in plan


def test_packing_equals_next_starts(spark):
    rng = np.random.default_rng(7)
    rows = [rng.choice([0, 0, 3, 20, 41, 90], n).tolist() for n in (1, 2, 127, 128, 129, 700)] + [[0, 0, 99, 0, 1], [0] * 300]
    d = spark.createDataFrame([(k, [(x, x + 1) for x in r]) for k, r in enumerate(rows)], "k int, s array<struct<size:bigint,bare:bigint>>")
    got = {r.k: r.c for r in d.select("k", annex._packed(F.col("s"), 40).alias("c")).collect()}
    for k, r in enumerate(rows):
        nxt, starts, p = sequences.next_starts(np.array(r), 40, lone=False), [], 0
        while p < len(r):
            starts.append(p)
            p = int(nxt[p])
        assert [i for i, c in enumerate(got[k]) if c.new or i == 0] == starts
        assert [c.before for c in got[k]] == [sum(r[:i]) + i for i in range(len(r))]


def test_unresolved_units_are_left_out_where_asked(spark):
    b = blocks(spark, ("EK-1.docx", ["body"]), ("EK-2 bir.docx", ["Eski metin: x"]), ("EK-2 iki.docx", ["Yeni metin: y"]))
    assert [(r.annex, r.text) for r in annex.chunks(b, unresolved="drop").collect()] == [("1", "body")]
    assert [(r.annex, r.text) for r in annex.chunks(b, unresolved="drop", made=annex.units(b)).collect()] == [("1", "body")]
    with pytest.raises(ValueError, match="unresolved"):
        annex.chunks(b, unresolved="keep")


def archive(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return hashlib.sha256(path.read_bytes()).hexdigest()


def test_conversions_stand_in_and_hashes_are_checked(spark, tmp_path):
    (tmp_path / "n").mkdir()
    good = docx([("EK-3", False), ("new", False)])
    (tmp_path / "n" / "ek-3.docx").write_bytes(good)
    zip_hash = archive(tmp_path / "x.zip", **{"EK-3.doc": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1old", "EK-4.doc": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "EK-5.docx": docx([("five", False)])})
    entry = {"archive_member_path": "EK-3.doc", "conversion_status": "SUCCESS", "normalized_relative_path": "n/ek-3.docx", "normalized_sha256": hashlib.sha256(good).hexdigest(), "normalization_tool": "t", "normalization_tool_version": "1", "normalization_command_family": "c"}
    failed = entry | {"archive_member_path": "EK-4.doc", "conversion_status": "FAILED"}

    def read(entries, of=zip_hash):
        (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "source_zip_sha256": of, "entries": entries}))
        files = spark.read.format("binaryFile").load(str(tmp_path / "n"))
        return office.read_archive(spark, str(tmp_path / "x.zip"), office.load_conversions(spark, str(tmp_path / "m.json")), files)

    b = read([entry, failed])
    got = {r.member: r for r in b.where("source_order = 0").collect()}
    assert got["EK-3.doc"].text == "EK-3" and got["EK-3.doc"].original == "ole" and got["EK-3.doc"].detected == "docx" and json.loads(got["EK-3.doc"].normalized)["normalization_tool"] == "t"
    assert got["EK-4.doc"].warning and got["EK-5.docx"].normalized is None and {r.archive_sha256 for r in got.values()} == {zip_hash}
    d = annex.diagnostics(b, annex.units(b)).first()
    assert d.readers == {"normalized_docx": 1, "legacy_doc": 1, "docx": 1} and d.provenance and not d.normalization
    for entries, of, why in (([entry | {"normalized_sha256": "0"}], zip_hash, "another hash"), ([entry], "0", "another archive"), ([entry | {"normalized_relative_path": "n/none.docx"}], zip_hash, "no converted file")):
        with pytest.raises(Exception, match=why):
            read(entries, of).collect()
    with pytest.raises(ValueError, match="twice"):
        read([entry, entry])


def test_a_large_archive_is_many_tasks(spark, tmp_path, monkeypatch):
    archive(tmp_path / "x.zip", **{f"EK-{k}.rtf": b"{\\rtf1 " + b"x" * 5000 + b"}" for k in range(1, 41)})
    monkeypatch.setattr(office, "TASK_BYTES", 20_000)
    b = office.read_archive(spark, f"file://{tmp_path}/x.zip")
    per = b.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per) == 40 and len(per) > 5
    assert [r.member for r in office.members(spark, str(tmp_path / "x.zip")).orderBy("member_order").collect()] == [f"EK-{k}.rtf" for k in range(1, 41)]
