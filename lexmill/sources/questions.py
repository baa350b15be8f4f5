"""Question sets and pipeline payloads in JSON: strict readers, adapters to qualified keys, unions.

A set is a JSON list or an object with a list; order in the file counts where ids must come in order. Rows are few
(tens a set); checks run on the driver's side of one small table, and what is wrong raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import chunking, parsing
from lexmill.operators.identity import to_source_keys
from lexmill.sources import files

#: Allowed values (fixed values of the data).
CASE_TYPES = ("paraphrase", "exception_condition", "multi_part", "long_tail", "ambiguity_resistant")
DIFFICULTIES = ("easy", "medium", "hard")
DOCUMENT_SCHEMA = "document-source-v1"

_SOURCE = "array<struct<legislation_number:string,article_type:string,article_no:string>>"
_QUESTION = f"id string, question string, expected_articles array<string>, expected_sources {_SOURCE}, dataset string, case_type string, difficulty string, source_verified boolean, gold_human_approved boolean, expert_validated boolean, notes string"
_DOCUMENT_QUESTION = "id string, question string, expected_sources array<struct<document_id:string,article_type:string,article_no:string>>, expected_document_ids array<string>"


def _fail_unless_empty(bad: DataFrame, what: str) -> None:
    if (row := bad.first()) is not None:
        raise ValueError(f"{what}: {row[0]}")


def _list(spark: SparkSession, path: str, element: str) -> DataFrame:
    """A JSON list in order: at (from 0) and the fields; anything else raises."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{_struct(element)}>>", {"mode": "FAILFAST"}).alias("x"))
    return raw.select(F.posexplode("x").alias("at", "q")).select("at", "q.*")


def _struct(ddl: str) -> str:
    """name kind, ... as name:kind,..."""
    out, depth, word = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return ",".join(x.replace(" ", ":", 1) for x in [*out, word.strip()])


def unique_questions(df: DataFrame) -> DataFrame:
    """df, once no id and no question (case and white space aside) is there twice."""
    for c, what in ((F.col("id"), "id twice"), (T.question_key("question"), "question twice")):
        _fail_unless_empty(df.groupBy(c.alias("k")).count().where("count > 1"), what)
    return df


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (T.strip(c) == "")


def load_set(spark: SparkSession, path: str, count: int | None = None, ids: list[str] | None = None, annotated: bool = False, approved: bool | None = None, datasets: tuple[str, ...] | None = None, least_keys: int = 0) -> DataFrame:
    """A question set, checked: fields and their values, ids in order, how many, repeated keys and questions.

    annotated: case type, difficulty, source_verified = true, expert_validated = false and notes are asked for. approved:
    what gold_human_approved must be. datasets: each source's law must be its row's dataset (or the only one).
    least_keys: distinct keys over all. Returns at, the fields and keys (array<struct>).
    """
    df = _list(spark, path, _QUESTION)
    n = df.count()
    if n == 0 or count is not None and n != count:
        raise ValueError(f"{n} questions where {count or 'some'} are expected")
    _fail_unless_empty(df.where(_blank("id") | _blank("question")).select("at"), "blank id or question at")
    if ids is not None:
        wanted = spark.createDataFrame(list(enumerate(ids)), "at int, wanted string")
        _fail_unless_empty(df.join(wanted, "at", "left").where(~F.col("id").eqNullSafe(F.col("wanted"))).select("id"), "id out of order")
    if annotated:
        fine = F.col("case_type").isin(*CASE_TYPES) & F.col("difficulty").isin(*DIFFICULTIES) & F.col("source_verified") & ~F.col("expert_validated") & ~_blank("notes")
        _fail_unless_empty(df.where(~F.coalesce(fine, F.lit(False))).select("id"), "annotation not valid")
    if approved is not None:
        _fail_unless_empty(df.where(~F.col("gold_human_approved").eqNullSafe(F.lit(approved))).select("id"), f"gold_human_approved must be {approved}")
    if datasets is not None:
        df = df.withColumn("dataset", F.coalesce("dataset", F.lit(datasets[0]) if len(datasets) == 1 else F.lit(None)))
        _fail_unless_empty(df.where(~F.coalesce(F.col("dataset").isin(*datasets), F.lit(False)) | (F.coalesce(F.size("expected_sources"), F.lit(-1)) < 1) | F.exists("expected_sources", lambda s: ~s["legislation_number"].eqNullSafe(F.col("dataset")))).select("id"), "sources not valid")
        df = df.withColumn("keys", F.transform("expected_sources", lambda s: F.struct(s["legislation_number"].alias("number"), s["article_type"].alias("article_type"), T.article_no(s["article_no"]).alias("article_no"))))
    else:
        _fail_unless_empty(df.where(F.coalesce(F.size("expected_articles"), F.lit(-1)) < 1).select("id"), "no expected articles")
        df = df.withColumn("keys", F.transform("expected_articles", lambda a: F.struct(F.lit(None).cast("string").alias("number"), F.lit("normal").alias("article_type"), T.article_no(a).alias("article_no"))))
    _fail_unless_empty(df.where(F.size(F.array_distinct("keys")) < F.size("keys")).select("id"), "a key twice")
    if least_keys and (k := df.select(F.explode("keys")).distinct().count()) < least_keys:
        raise ValueError(f"{k} distinct keys where {least_keys} are expected")
    return unique_questions(df)


def qualified(df: DataFrame, law: str | None = None) -> DataFrame:
    """Any set as id, question, dataset, keys, laws, case_type, difficulty: the common form of benchmarks."""
    keys = F.transform("keys", lambda k: F.struct(F.coalesce(k["number"], F.lit(law)).alias("number"), k["article_type"].alias("article_type"), k["article_no"].alias("article_no")))
    dataset = F.coalesce(F.col("dataset"), F.lit(law))
    return df.select("id", "question", dataset.alias("dataset"), keys.alias("keys"), F.array_distinct(F.transform(keys, lambda k: k["number"])).alias("laws"), "case_type", "difficulty")


def combined(*sets: DataFrame) -> DataFrame:
    """Sets in one table by name; an id or a question in two of them raises."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return unique_questions(out)


def by_document(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """qualified() questions -> id, question, dataset, source_keys, document_ids, through a registry of legacy numbers."""
    rows = questions.select("id", F.explode("keys").alias("k")).select("id", "k.number", "k.article_type", "k.article_no")
    made = to_source_keys(rows, registry).groupBy("id").agg(F.array_sort(F.collect_set("source_key")).alias("source_keys"), F.array_sort(F.collect_set("document_id")).alias("document_ids"))
    return questions.select("id", "question", "dataset").join(made, "id")


def load_document_questions(spark: SparkSession, path: str) -> DataFrame:
    """The tagged schema: an object of exactly source_identity_schema and questions of exactly four fields -> id, question, source_keys, document_ids in order of ids."""
    value = spark.read.text(path, wholetext=True)
    keys = value.select(F.json_object_keys("value").alias("k"), F.get_json_object("value", "$.source_identity_schema").alias("s")).first()
    if keys is None or set(keys["k"] or ()) != {"source_identity_schema", "questions"} or keys["s"] != DOCUMENT_SCHEMA:
        raise ValueError("not the tagged schema of document questions")
    raw = value.select(F.explode(F.from_json(F.get_json_object("value", "$.questions"), "array<string>")).alias("q"))
    fields = F.array_sort(F.json_object_keys("q"))
    _fail_unless_empty(raw.where(~F.coalesce(fields == F.array(*map(F.lit, sorted(("id", "question", "expected_sources", "expected_document_ids")))), F.lit(False))).select("q"), "fields not valid")
    df = raw.select(F.from_json("q", f"struct<{_struct(_DOCUMENT_QUESTION)}>", {"mode": "FAILFAST"}).alias("q")).select("q.*")
    if df.isEmpty():
        raise ValueError("no questions")
    _fail_unless_empty(df.where(_blank("id") | _blank("question") | (F.size("expected_sources") < 1)).select("id"), "question not valid")
    out = df.select("id", "question", F.transform("expected_sources", lambda s: T.source_key(s["document_id"], s["article_type"], s["article_no"])).alias("source_keys"), F.array_sort("expected_document_ids").alias("document_ids"))
    mine = F.array_sort(F.array_distinct(F.transform("source_keys", lambda k: F.split(k, "/")[0])))
    _fail_unless_empty(out.where(mine != F.col("document_ids")).select("id"), "documents that aren't the sources'")
    _fail_unless_empty(out.groupBy("id").count().where("count > 1"), "id twice")
    return out.orderBy("id")


def document_questions_json(questions: DataFrame) -> DataFrame:
    """load_document_questions()'s rows as one row `value`: the tagged object again, questions by id."""
    source = F.transform("source_keys", lambda k: F.struct(F.split(k, "/", 3)[0].alias("document_id"), F.split(k, "/", 3)[1].alias("article_type"), F.split(k, "/", 3)[2].alias("article_no")))
    one = F.struct("id", "question", source.alias("expected_sources"), F.col("document_ids").alias("expected_document_ids"))
    return questions.agg(F.to_json(F.struct(F.lit(DOCUMENT_SCHEMA).alias("source_identity_schema"), F.array_sort(F.collect_list(one)).alias("questions"))).alias("value"))


# payloads ---------------------------------------------------------------------

_PARAGRAPHS = "document_id string, source_file string, paragraph_count long, paragraphs array<struct<index:int,text:string,style_name:string,footnote_reference_ids:array<int>>>"
_CHUNKS = "document_id string, chunk_count long, chunks array<struct<chunk_id:string,article_id:string,article_no:string,article_type:string,article_title:string,section_context:string,text:string,paragraph_numbers:array<string>>>"


def _payload(spark: SparkSession, path: str, schema: str, rows: str, count: str, lines: bool) -> DataFrame:
    df = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    _fail_unless_empty(df.where(F.col("document_id").isNull() | F.col(rows).isNull() | ~F.col(count).eqNullSafe(F.size(rows).cast("long"))).select("document_id"), f"{count} is not the number of {rows}")
    return df.select("document_id", *(["source_file"] if "source_file" in df.columns else []), F.inline(rows))


def load_paragraphs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Files of one document's paragraphs each (lines: files with a document a line) -> document_id, source_file, index, text, style_name, footnotes; the declared number must be right."""
    return _payload(spark, path, _PARAGRAPHS, "paragraphs", "paragraph_count", lines).withColumnRenamed("footnote_reference_ids", "footnotes")


def load_chunks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Files of one document's chunks each (lines: files with a document a line) -> document_id and the chunk's fields."""
    return _payload(spark, path, _CHUNKS, "chunks", "chunk_count", lines)


def paragraphs_json(paragraphs: DataFrame, source_file: str) -> DataFrame:
    """document_id, value: the payload that load_paragraphs() reads."""
    rows = F.array_sort(F.collect_list(F.struct("index", "text", "style_name", F.col("footnotes").alias("footnote_reference_ids"))))
    return paragraphs.groupBy("document_id").agg(rows.alias("p")).select("document_id", F.to_json(F.struct("document_id", F.lit(source_file).alias("source_file"), F.size("p").alias("paragraph_count"), F.col("p").alias("paragraphs"))).alias("value"))


def parse_documents(spark: SparkSession, path: str, manifest: DataFrame, project_root: str = "/", limit: int | None = 4000) -> tuple[DataFrame, DataFrame]:
    """Paragraph files, admitted by the manifest (files.admitted), as (articles, chunks), each with its document_id."""
    p = files.admitted(load_paragraphs(spark, path), manifest, project_root)
    articles = parsing.articles(p)
    keyed = articles.withColumn("article_id", F.concat_ws("\u001f", "document_id", "article_id"))
    c = chunking.article_chunks(keyed, limit)
    of = lambda c: F.split(c, "\u001f")
    return articles, c.select(of("chunk_id")[0].alias("document_id"), of("article_id")[1].alias("article_id"), of("chunk_id")[1].alias("chunk_id"), "paragraph_numbers", "text")
