"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

1. Lexicon. Over labelled rows of the learning folds (at most FIT_ROWS of them, the lowest by hash of
   doc_id), words and their beginnings of 4 to 9 letters are counted by label; those that tell toxic rows
   best (a binomial log-likelihood ratio, at least LEAST and SHARE of the toxic rows, a ratio of odds of at least ODDS)
   become lexicon entries, up to ENTRIES; of a word and its beginnings that mark the same rows one is kept.
2. Voters. All entries each vote "toxic" where they occur and abstain elsewhere; PATTERNS
   (shouting, runs of marks, ...) vote too. Votes are made for every document.
3. Label model. A document's class is hidden; given the class, voters vote at rates mu[class] (their
   accuracies) and with a common covariance, which gives their correlations rho. The parameters start from
   the learning rows' labels and are refined by expectation-maximisation over all documents' votes (rows
   with a learning label keep it). A vote counts log(mu1 / mu0), divided by 1 + its correlations with the
   other votes cast, so that voters that repeat each other share one weight; an abstention counts nothing
   by itself, but a text without any lexicon vote has its own ratio.
   What is gathered for it are sums over votes and over pairs of votes that are cast together: at most
   some ENTRIES^2 numbers.
4. Classifier. A logistic regression over all entries and patterns, trained on at most FIT_ROWS documents
   (the lowest by hash; learning labels where known, else the label model's posteriors) and on the posterior
   of each lexicon voter's vote alone, scores every whole text.

A score sees the text alone. A null or empty text has no entry and gets the classifier's intercept. Rows
that repeat get the same score. Without labels, or without any toxic one, every score is the prior, 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import common as C

#: Documented bounds of what is fitted: rows of a sample, lexicon entries; rounds of the label model.
FIT_ROWS, ENTRIES, ROUNDS = 12_000, 1024, 3
CACHE = 150_000  # words whose entries a task keeps
PAIRS = 2_000_000  # pairs of votes that are in memory at once
LEAST, SHARE, ODDS = 4, 0.01, 40.0
STEMS = (4, 5, 6, 7, 8, 9)

_STRIP = re.compile(r"^\W+|\W+$")
PATTERNS = (
    re.compile(r"!{3,}|\?{3,}"),
    re.compile(r"\b[A-ZÄÖÜ]{4,}(?:\W+[A-ZÄÖÜ]{4,}){3}"),
    re.compile(r"\b(?:is|are|bist|ist|es|est)\s+(?:an?\s+)?(\w+)\s+\1\b", re.I),
    re.compile(r"[$%&*#]{3,}"),
)


def words(text: str) -> set[str]:
    return set(text.lower().split())


def entries_of(word: str) -> list[str]:
    """What a word may be an entry by: itself, without marks around it, and its beginnings (with a star)."""
    w = _STRIP.sub("", word)
    return [w, *(w[:k] + "*" for k in STEMS if len(w) >= k)] if w else []


class Lexicon(dict):
    """word -> ids of the entries that it has; keeps words seen, within bounds."""

    def __init__(self, entries: list[str]):
        super().__init__()
        self.ids = {x: k for k, x in enumerate(entries)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE:
            self.clear()
        out = self[word] = tuple(k for x in entries_of(word) if (k := self.ids.get(x)) is not None)
        return out

    def of(self, text: str | None) -> list[int]:
        """Sorted ids of a text's entries, then of its patterns (from len(entries) on)."""
        text = text or ""
        found = set()
        for ids in filter(None, map(self.__getitem__, words(text))):
            found.update(ids)
        return sorted(found) + [len(self.ids) + k for k, p in enumerate(PATTERNS) if p.search(text)]


def bounded(df: DataFrame, rows: int, total: int) -> DataFrame:
    """At most `rows` rows, those of the lowest hashes of all columns; all when there are no more. Hashes are cut off first, so that few rows are sorted; equal rows may all be cut off."""
    if total <= rows:
        return df
    h = F.pmod(F.xxhash64(F.lit("fit"), *df.columns), F.lit(1 << 40))
    return df.where(h < int((1 << 40) * min(1.0, 1.5 * rows / total))).orderBy(h, *df.columns).limit(rows)


def learn_lexicon(fit: DataFrame) -> list[str]:
    """fit(text, toxic) -> entries, best first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin("toxicity")
        got: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for b in C.slices(batches):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = set()
                for w in words(text or ""):
                    found.update(entries_of(w))
                got[y].update(found)
                rows[y] += 1
        # clean rows' entries too: whether some toxic row has an entry is known only over all tasks
        names = ["", *(got[0] | got[1])]
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([rows[1] if not x else got[1][x] for x in part], pa.int64()), pa.array([rows[0] if not x else got[0][x] for x in part], pa.int64())], ["entry", "toxic", "clean"])

    counted = fit.select("text", "toxic").mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    total = counted.where("entry = ''").first()
    if total is None or not total["a"]:
        return []
    p, n = float(total["a"]), float(total["b"])
    a, b = F.col("a"), F.col("b")
    odds = ((a + 0.5) / (p - a + 0.5)) / ((b + 0.5) / (n - b + 0.5))
    x = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    share = (a + b) / (p + n)
    gain = x(a, p * share) + x(b, n * share) + x(p - a, p * (1 - share)) + x(n - b, n * (1 - share))
    best = counted.where((F.col("entry") != "") & (a >= max(LEAST, SHARE * p)) & (odds >= ODDS)).select("entry", "a", F.round(gain, 6).alias("gain")).orderBy(F.desc("gain"), "entry").limit(4 * ENTRIES)
    kept: dict[str, int] = {}
    for r in best.collect():
        stem = r["entry"].rstrip("*")
        if not any(abs(r["a"] - n) <= 0.1 * n and (stem.startswith(x.rstrip("*")) or x.startswith(stem)) for x, n in kept.items()):
            kept[r["entry"]] = r["a"]
            if len(kept) == ENTRIES:
                break
    return list(kept)


def votes_of(docs: DataFrame, entries: list[str], cols: list[str]) -> DataFrame:
    """docs -> cols and `ids`: each text's entries and patterns."""
    n = len(cols)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin("toxicity")
        lex = Lexicon(entries)
        for b in C.slices(batches):
            ids = pa.array([lex.of(t) for t in b.column(n).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], ids], [*cols, "ids"])

    picked = docs.select(*cols, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[:n])
    return picked.mapInArrow(vote, f"{schema}, ids array<int>")


class Votes:
    """Some texts' votes as flat arrays: the row and the voter of each vote, and the pairs of votes of one row."""

    def __init__(self, ids: list[list[int]]):
        size = np.array([len(x) for x in ids], np.int64)
        self.n = len(ids)
        self.row = np.repeat(np.arange(self.n), size)
        self.col = np.fromiter((k for x in ids for k in x), np.int64, len(self.row))
        mates = size[self.row]
        self.left = np.repeat(np.arange(len(self.row)), mates)
        self.right = np.arange(len(self.left)) + np.repeat((np.cumsum(size) - size)[self.row] - np.cumsum(mates) + mates, mates)

    @staticmethod
    def cut(ids: list[list[int]]) -> Iterator[slice]:
        """Slices of at most PAIRS pairs, or of one row."""
        first, total = 0, 0
        for k, x in enumerate(ids):
            if k > first and total + len(x) ** 2 > PAIRS:
                yield slice(first, k)
                first, total = k, 0
            total += len(x) ** 2
        if ids:
            yield slice(first, len(ids))


class LabelModel:
    """Hidden class, voters' means by class, common covariance."""

    def __init__(self, n_entries: int):
        self.n_entries, self.width = n_entries, n_entries + len(PATTERNS)

    def voted(self, v: Votes) -> np.ndarray:
        """Whether any lexicon voter voted."""
        return np.bincount(v.row[v.col < self.n_entries], minlength=v.n) > 0

    def posterior(self, ids: list[list[int]]) -> np.ndarray:
        out = np.zeros(len(ids))
        for at in Votes.cut(ids):
            v = Votes(ids[at])
            share = 1 + np.bincount(v.left, self.rho[v.col[v.left], v.col[v.right]], len(v.col))
            z = np.bincount(v.row, self.w[v.col] / share, v.n) + np.where(self.voted(v), self.b, self.b_none)
            out[at] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out

    def set(self, s: np.ndarray) -> None:
        """From sums by class: [count, votes, votes x votes, rows without a vote]."""
        j = self.width
        n = np.maximum(s[:, 0], 1e-9)
        mu = (s[:, 1 : 1 + j] + 0.1) / (n[:, None] + 1)
        second = s[:, 1 + j : -1].reshape(2, j, j)
        sigma = sum(second[y] - n[y] * np.outer(mu[y], mu[y]) for y in (0, 1)) / n.sum()
        d = np.sqrt(np.maximum(np.diag(sigma), 1e-9))
        self.mu, self.prior = mu, n[1] / n.sum()
        self.rho = np.clip(sigma / np.outer(d, d), 0, 1)  # voters that never vote together have none
        np.fill_diagonal(self.rho, 0)
        self.w = np.log(mu[1] / mu[0])
        self.b = np.log(n[1] / n[0])
        none = (s[:, -1] + 0.1) / (n + 1)
        self.b_none = self.b + np.log(none[1] / none[0])


def _sums(votes: DataFrame, model: LabelModel, labelled_only: bool) -> np.ndarray:
    """Sums by class over votes(ids, label): label where known, else the posterior."""
    j = model.width

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((2, 2 + j + j * j))
        for b in batches:
            ids, label = b.column(0).to_pylist(), b.column(1).to_pylist()
            if labelled_only:
                ids, label = [x for x, y in zip(ids, label, strict=True) if y is not None], [y for y in label if y is not None]
            y = np.array([np.nan if x is None else x for x in label], float)
            if not labelled_only:
                unknown = np.flatnonzero(np.isnan(y))
                y[unknown] = model.posterior([ids[k] for k in unknown.tolist()])
            for at in Votes.cut(ids):
                v = Votes(ids[at])
                pair, none = v.col[v.left] * j + v.col[v.right], ~model.voted(v)
                kinds, of = np.unique(pair, return_inverse=True)
                for c, p in ((0, 1 - y[at]), (1, y[at])):
                    s[c, 0] += p.sum()
                    s[c, 1 : 1 + j] += np.bincount(v.col, p[v.row], j)
                    s[c, 1 + j + kinds] += np.bincount(of, p[v.row[v.left]], len(kinds))
                    s[c, -1] += p[none].sum()
        flat = s.ravel()
        k = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(flat[k])], ["k", "s"])

    got = votes.select("ids", "label").mapInArrow(add, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toArrow()  # pairs of voters that vote together
    out = np.zeros(2 * (2 + j + j * j))
    out[got.column("k").to_numpy()] = got.column("s").to_numpy()
    return out.reshape(2, -1)


def fit_linear(ids: list[list[int]], y: np.ndarray, width: int, l2: float = 1e-5, steps: int = 4000) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton-scaled gradient steps with momentum; deterministic."""
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    col = np.fromiter((k for x in ids for k in x), np.int64, len(row))
    w, b, vw, vb = np.zeros(width), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(width), 0.0
    size = np.maximum(np.bincount(col, minlength=width), 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(ids)) + b, -30, 30)))
        g = p - y
        gw = np.bincount(col, g[row], width) / np.sqrt(size * len(ids)) + l2 * w
        vw, vb = 0.9 * vw - 2.0 * gw, 0.9 * vb - 2.0 * g.mean()
        w, b = w + vw, b + vb
    return w, b


class Model:
    """entries, weights (entries, then patterns), intercept; empty entries: the prior alone."""

    def __init__(self, entries: list[str], w: np.ndarray, b: float, label_model: LabelModel | None = None):
        self.entries, self.w, self.b, self.label_model = entries, w, b, label_model


def fit(docs: DataFrame, labels: DataFrame, learn=lambda doc_id: C.fold(doc_id) != 0) -> Model:
    """Learns from labels(doc_id, toxic) of rows that `learn` admits; docs(doc_id, text): all documents."""
    model, votes = fit_votes(docs, labels, learn)
    C.drop(votes)
    return model


def fit_votes(docs: DataFrame, labels: DataFrame, learn=lambda doc_id: C.fold(doc_id) != 0) -> tuple[Model, DataFrame]:
    """fit()'s model and every document's entries (doc_id, ids), which it has made on the way."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = known.count()
    if not rows:
        return Model([], np.zeros(len(PATTERNS)), -30.0), votes_of(docs, [], ["doc_id"])
    sample = docs.select("doc_id", "text").join(bounded(known, FIT_ROWS, rows), "doc_id")
    entries = learn_lexicon(sample)
    if not entries:
        return Model([], np.zeros(len(PATTERNS)), -30.0), votes_of(docs, [], ["doc_id"])
    made = votes_of(docs, entries, ["doc_id"]).join(known.withColumnRenamed("toxic", "label"), "doc_id", "left")
    votes = C.materialize(made, "tox-votes")
    model = LabelModel(len(entries))
    model.set(_sums(votes, model, labelled_only=True))
    for _ in range(ROUNDS):
        model.set(_sums(votes, model, labelled_only=False))
    total = votes.count()
    got = bounded(votes.select("doc_id", "ids", "label"), FIT_ROWS, total).select("ids", "label").toArrow()
    ids = got.column("ids").to_pylist() + [[k] for k in range(len(entries))]  # and, for each lexicon voter, a text that has its vote alone
    y = model.posterior(ids)
    for k, label in enumerate(got.column("label").to_pylist()):
        if label is not None:
            y[k] = label
    w, b = fit_linear(ids, y, len(entries) + len(PATTERNS)) if len(ids) else (np.zeros(len(entries) + len(PATTERNS)), -30.0)
    return Model(entries, w, b, model), votes


def score_votes(votes: DataFrame, model: Model) -> DataFrame:
    """votes(doc_id, ids) -> doc_id, score."""
    w = F.array(*(F.lit(float(x)) for x in model.w))
    z = F.aggregate("ids", F.lit(float(model.b)), lambda a, k: a + F.element_at(w, k + 1))
    return votes.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def score(docs: DataFrame, model: Model, cols: list[str], name: str = "score") -> DataFrame:
    """docs -> cols and the score of the whole text, under the given name."""
    n = len(cols)
    entries, w, b0 = model.entries, model.w, model.b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin("toxicity")
        lex = Lexicon(entries)
        for b in C.slices(batches):
            z = np.array([b0 + sum(w[k] for k in lex.of(t)) for t in b.column(n).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], [*b.schema.names[:n], name])

    cols = [f"`{c}`" for c in cols]
    picked = docs.select(*cols, F.col("text").alias(*C.free_names(docs.select(*cols), "whole_text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:n])
    return picked.mapInArrow(run, f"{schema}, `{name}` double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs' rows and columns without the texts that score threshold or more. The score's name on the way is one that docs doesn't have."""
    model = fit(docs, labels)
    (name,) = C.free_names(docs, "toxicity")
    return score(docs, model, docs.columns, name).where(F.col(name) < threshold).select(*(f"`{c}`" for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: score of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model, votes = fit_votes(docs, labels)
    out = score_votes(votes, model)
    return out.select("doc_id", (C.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
