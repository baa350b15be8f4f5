"""Calls of providers from tasks: a few in flight, each counted, and paid ones at most once.

A provider is any function that can be sent to tasks. Embed takes a text and gives vectors and the tokens used; Generate takes
instructions, the messages and a temperature and gives a Reply. Numbers of tokens that aren't whole are unknown (null), and a
sum with an unknown one is unknown (metrics.sum_or_null).
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import checks
from lexmill.operators import answering, retrieval
from lexmill.sources import shared

Embed = Callable[[str], tuple[list[list[float]], object]]
IN_FLIGHT = 4


@dataclass(frozen=True)
class Reply:
    text: str
    input_tokens: object = None
    output_tokens: object = None
    total_tokens: object = None


class TemperatureRefused(Exception):
    """What a Generate raises when the model takes no temperature: it is asked once more without one."""


Generate = Callable[[str, list[dict[str, str]], float | None], Reply]


def whole(x: object) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) else None


def _each(run: Callable, rows: list[tuple], in_flight: int) -> list:
    """run over rows, in order, at most in_flight at a time; the first error stops what hasn't begun."""
    with ThreadPoolExecutor(max(1, in_flight)) as pool:
        tasks = [pool.submit(run, *r) for r in rows]
        try:
            return [t.result() for t in tasks]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise


def one_vector(embed: Embed, text: str | None) -> tuple[list[float], int | None]:
    """The one vector of a question, which is sent as it is; another number of vectors, an empty one or numbers that aren't finite raise."""
    if text is None or not text.strip():
        raise ValueError("a question must not be empty")
    vectors, tokens = embed(text)
    if len(vectors) != 1:
        raise ValueError(f"{len(vectors)} vectors for one question")
    v = list(vectors[0])
    if not v or any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for x in v):
        raise ValueError("the question's vector is empty or has what is no number")
    return [float(x) for x in v], whole(tokens)


def embed_questions(questions: DataFrame, embed: Embed, in_flight: int = IN_FLIGHT) -> DataFrame:
    """questions(query_id long, question) -> query_id, question, q, tokens: a call a question."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = _each(lambda t: one_vector(embed, t), [(t,) for t in b.question], in_flight)
            yield pd.DataFrame({"query_id": b.query_id, "question": b.question, "q": [v for v, _ in made], "tokens": pd.array([n for _, n in made], dtype="Int64")})

    return questions.select("query_id", "question").mapInPandas(run, "query_id long, question string, q array<double>, tokens long")


def retrieve(questions: DataFrame, chunks: DataFrame, embed: Embed, k: int, metric: str = "l2", vector: str = "v", in_flight: int = IN_FLIGHT) -> DataFrame:
    """Raw questions in, ranked chunks out. questions(query_id, question), chunks(id, text, <vector>, ...) -> query_id, question, results, requested, returned, metric, tokens.

    Filter chunks before, as for dense_topk. Questions with no chunk have no results. Each question is embedded once: what is embedded is written.
    """
    checks.positive("k", k), checks.positive("in_flight", in_flight)
    from lexmill.sources.files import scratch

    spark = questions.sparkSession
    path = scratch(spark, "questions")
    made = embed_questions(questions, embed, in_flight)
    made.write.parquet(path)
    made = spark.read.schema(made.schema).parquet(path)
    ranked = retrieval.dense_topk(made.select("query_id", "q"), chunks.select("id", F.col(vector).alias("v")), k, metric, exclude_self=False)
    found = answering.retrieve(made.select("query_id", "question"), ranked.select("query_id", "rank", "id", "distance"), chunks.drop(vector), k)
    return found.join(made.select("query_id", "tokens"), "query_id").select("query_id", "question", "results", F.lit(k).alias("requested"), F.size("results").alias("returned"), F.lit(metric).alias("metric"), "tokens")


def generate(retrieved: DataFrame, call: Generate, temperature: float | None = None, in_flight: int = IN_FLIGHT, strict: bool = True) -> DataFrame:
    """retrieve()'s rows -> answering.generate's columns + input_tokens, output_tokens, total_tokens, retried.

    A call gets the instructions and answering.input_items' messages. Without results there is no call, and no usage. An empty reply raises.
    """

    def one(items: str | None) -> tuple:
        if items is None:
            return None, None, None, None, False
        messages = json.loads(items)
        try:
            reply, again = call(answering.INSTRUCTIONS, messages, temperature), False
        except TemperatureRefused:
            if temperature is None:
                raise
            reply, again = call(answering.INSTRUCTIONS, messages, None), True
        if not isinstance(reply.text, str) or not reply.text.strip():
            raise ValueError("a reply without text")
        return reply.text, whole(reply.input_tokens), whole(reply.output_tokens), whole(reply.total_tokens), again

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = _each(one, [(x,) for x in b["items"]], in_flight)
            cols = list(zip(*made, strict=True)) or [()] * 5
            yield pd.DataFrame({"query_id": b.query_id, "raw": cols[0], **{n: pd.array(cols[j], dtype="Int64") for j, n in enumerate(("input_tokens", "output_tokens", "total_tokens"), 1)}, "retried": list(cols[4])})

    d = retrieved.withColumn("context", answering.context_of("results", answering.header_fields(retrieved)))
    items = F.when(F.size("results") > 0, F.to_json(answering.input_items(F.col("question"), F.col("context"))))
    from lexmill.sources.files import scratch

    spark = retrieved.sparkSession
    path = scratch(spark, "replies")  # a call is made once, whatever is done with its reply
    replies = d.select("query_id", items.alias("items")).mapInPandas(run, "query_id long, raw string, input_tokens long, output_tokens long, total_tokens long, retried boolean")
    replies.write.parquet(path)
    replies = spark.read.schema(replies.schema).parquet(path)
    usage = ("input_tokens", "output_tokens", "total_tokens", "retried")
    done = answering.checked_answers(d.join(replies.select("query_id", "raw"), "query_id"), strict)
    return done.join(replies.select("query_id", *usage), "query_id")


class Ambiguous(RuntimeError):
    """A paid call began and its result isn't there: whether it was paid nobody knows, so nothing is called again."""


def paid(batches: DataFrame, root: str, call: Callable[[list[str]], tuple[list[list[float]], object]]) -> DataFrame:
    """batches(batch, position, id, text) -> batch, id, vector, tokens (of its whole batch): each batch is one paid call, made at most once, ever.

    Before a call its attempt is noted under root, exclusively; its result is put there whole. A batch whose result is there isn't called: the result
    is read, and its ids and texts must be the same, or ValueError. An attempt without a result raises Ambiguous, in the run that finds it and
    in a second attempt of a task; remove the note to have it called again. A run that is lost before the note or after the result goes
    on where it was. Batches are bounded by their maker (sequences.cut); nulls in texts are empty.
    """

    def run(key, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("position")
        ids, texts = [str(x) for x in b.id], [t or "" for t in b.text]
        digest = hashlib.sha256(json.dumps([ids, texts]).encode()).hexdigest()
        path = f"{root.rstrip('/')}/batch-{int(key[0]):09d}"
        if not shared.is_there(f"{path}.json"):
            if not shared.claim(f"{path}.attempt.json", json.dumps({"digest": digest, "ids": ids}).encode()):
                raise Ambiguous(f"batch {key[0]} was begun and has no result")
            vectors, tokens = call(texts)
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            shared.deliver(f"{path}.json", json.dumps({"digest": digest, "ids": ids, "vectors": [[float(x) for x in v] for v in vectors], "tokens": whole(tokens)}).encode())
        saved = json.loads(shared.read(f"{path}.json"))
        if saved["digest"] != digest:
            raise ValueError(f"batch {key[0]} was made of other inputs")
        return pd.DataFrame({"batch": int(key[0]), "id": ids, "vector": saved["vectors"], "tokens": pd.array([saved["tokens"]] * len(ids), dtype="Int64")})

    return batches.select("batch", "position", F.col("id").cast("string").alias("id"), "text").groupBy("batch").applyInPandas(run, "batch long, id string, vector array<double>, tokens long")
