"""Embedding through a provider, each distinct text once; a deterministic provider for tests and offline runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from lexmill.functions import text as T

Provider = Callable[[list[str]], tuple[list[list[float]], int | None]]


def hash_projection(dimensions: int = 64) -> Provider:
    """Sum of pseudo-random directions of a text's words, of length one; tokens: words."""

    def embed(texts: list[str]) -> tuple[list[list[float]], int | None]:
        out, n = [], 0
        for t in texts:
            v = np.zeros(dimensions)
            for w in t.lower().split() or [""]:
                seed = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little")
                v += np.random.default_rng(seed).normal(size=dimensions)
                n += 1
            out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32).tolist())
        return out, n

    return embed


def embed_texts(df: DataFrame, text: str, provider: Provider, batch: int = 64) -> DataFrame:
    """df + embedding (array<float>): distinct texts go to the provider in batches, in order; results of another number, of mixed dimensions or with numbers that aren't finite raise."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = None
        for p in parts:
            texts = p["__text"].tolist()
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                if any(not t or not t.strip() for t in some):
                    raise ValueError("a blank text can't be embedded")
                vectors, _ = provider(some)
                if len(vectors) != len(some):
                    raise ValueError(f"{len(vectors)} vectors for {len(some)} texts")
                for v in vectors:
                    size = size or len(v)
                    if len(v) != size or not np.isfinite(v).all():
                        raise ValueError("a vector of another dimension or with numbers that aren't finite")
                yield pd.DataFrame({"__text": some, "embedding": vectors})

    once = df.select(F.col(text).alias("__text")).distinct().mapInPandas(run, "__text string, embedding array<float>")
    return df.join(once, df[text] == once["__text"]).drop("__text")


def token_counts(df: DataFrame, text: str, ranks: str, pattern: str, name: str = "tokens") -> DataFrame:
    """df + how many tokens each text has in a byte-level vocabulary of the tiktoken library (ranks: its file, pattern: how it parts texts); special tokens' strings are plain text, null has 0. For planning only: nothing is sent."""
    schema = T_.StructType([*(T_.StructField(f.name, f.dataType, f.nullable) for f in df.schema), T_.StructField(name, T_.LongType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        for p in parts:
            p[name] = [len(enc.encode_ordinary(t or "")) for t in p[text]]
            yield p

    return df.mapInPandas(run, schema)


def display_title(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """chunks(document_id, legislation_number, ...) + display_title from the manifest, by document, else by number; the number goes before a title that doesn't have it; else the document's id."""
    by_id = manifest.select("document_id", F.col("title").alias("t1"), F.col("legislation_number").alias("n1"))
    by_no = manifest.where("legislation_number is not null").select("legislation_number", F.col("title").alias("t2"))
    j = chunks.join(by_id, "document_id", "left").join(by_no, "legislation_number", "left")
    title, number = F.coalesce("t1", "t2"), F.coalesce("n1", F.when(F.col("t1").isNull(), F.col("legislation_number")))
    full = F.when(number.isNotNull() & ~title.contains(number), F.concat(number, F.lit(" Sayılı "), title)).otherwise(title)
    return j.withColumn("display_title", F.coalesce(full, "document_id", F.concat("legislation_number", F.lit(" Sayılı Kanun")))).drop("t1", "t2", "n1")


def embedding_text(title: Column, article_type: Column, number: Column, article_title: Column, text: Column) -> Column:
    return T.embedding_text(title, T.article_label(article_type, number), article_title, text)
