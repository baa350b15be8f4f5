"""Mixing sources to target weights: hierarchical budgets over domain > language > source, DataFrame operations only.

Budgets. A leaf can give its tokens `epochs` times. A node's capacity is the sum of its leaves'. From the
root down, a node's budget is dealt to its children by weight; a child whose capacity is below its share
gets its capacity and the rest goes to its siblings by weight, until all is dealt. As a node's own budget
never exceeds its capacity, a shortage is made up among siblings first and reaches an ancestor's other
branches only as far as the siblings can't. With children in ascending order of capacity / weight this has
a closed form: the first ones are full as long as capacity / weight <= what is left / weight left. Levels
are windows over the tables of nodes (never over rows of documents).

Selection. Epoch e of a leaf is its documents in ascending order of md5(seed:e:doc_id). Full epochs are taken
whole; of the last one the prefix is taken whose tokens fit the budget, and with it the document in which
the budget ends. Prefix sums have two levels: documents fall into buckets by the first hex digits of that
hash, which keeps their order, buckets' sums are added up first, then those within each bucket; digits grow
with the table, so neither window holds more than a bounded share of a leaf whatever the leaf's share.

A document's tokens are its words. Domain is a column if there is one, else one of DOMAINS by the first hex digit of md5(source).
Null domain, lang or source are values of their own (''), null doc_id counts as the text 'null'; documents
without words weigh nothing and belong to the full epochs only (as copies 0 of a prefix unless it starts
with them). Weights that aren't given are 1; a weight of 0 gives nothing. Rows that repeat stay rows: ties
are broken by text hash, equal rows share a place and are taken together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm import common as C

LEVELS = ("domain", "language", "source")
DOMAINS = 3
#: Production parameters: half of all tokens, at most two epochs of a source.
FRACTION, EPOCHS, SEED = 0.5, 2, 17
DOMAIN_WEIGHTS = {"d0": 5.0, "d1": 3.0, "d2": 2.0}
LANGUAGE_WEIGHTS = {"en": 4.0, "de": 3.0, "fr": 2.0, "es": 2.0}
SOURCE_WEIGHTS = {"src0": 2.0}
BUCKET_ROWS, BROADCAST_LEAVES = 4096, 100_000


def weight(col: str, weights: dict[str, float]) -> Column:
    """A weight by value; 1 where none is given."""
    out = F.lit(1.0)
    for k in sorted(weights):
        out = F.when(F.col(col) == k, F.lit(float(weights[k]))).otherwise(out)
    return out


def deal(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """nodes(parent..., child, weight, capacity, parent_budget) + budget: the parent's budget dealt to its children."""
    order = Window.partitionBy(*parent).orderBy(F.col("fill").asc(), F.col(child).asc()) if parent else Window.partitionBy(F.lit(0)).orderBy("fill", child)
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = (
        nodes.withColumn("fill", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("left", F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", (F.col("weight") > 0) & (F.col("fill") * F.col("weight_left") <= F.col("left")))
    )
    full = F.col("full").cast("double")
    rest = F.col("parent_budget") - F.sum(full * F.col("capacity")).over(all_)
    open_ = F.sum((1 - full) * F.col("weight")).over(all_)
    share = F.when(F.col("weight") > 0, rest * F.col("weight") / open_).otherwise(0.0)
    return x.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share)).drop("fill", "left", "weight_left", "full")


def budgets(leaves: DataFrame, total: Column, epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """leaves(domain, language, source, tokens) -> those with their budget. total: what the root gets, over all_tokens."""
    w = leaves.withColumn("capacity", F.col("tokens").cast("double") * epochs)
    for level in LEVELS:
        w = w.withColumn(f"w_{level}", weight(level, weights.get(level, {})))
    whole = Window.partitionBy(F.lit(0))  # of the leaves, which are few
    open_ = (F.col("w_domain") > 0) & (F.col("w_language") > 0) & (F.col("w_source") > 0)
    w = w.withColumn("capacity", F.when(open_, F.col("capacity")).otherwise(0.0)).withColumn("all_tokens", F.sum("tokens").over(whole).cast("double"))
    w = w.withColumn("root", F.least(total, F.sum("capacity").over(whole)))
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        at = [*parent, level]
        up = "root" if depth == 0 else f"b_{LEVELS[depth - 1]}"
        nodes = w.groupBy(*at).agg(F.sum("capacity").alias("capacity"), F.max(f"w_{level}").alias("weight"), F.max(up).alias("parent_budget"))
        w = w.join(deal(nodes, parent, level).select(*at, F.col("budget").alias(f"b_{level}")), at)
    return w.select(*LEVELS, "tokens", F.col("b_source").alias("budget"))


def select(docs: DataFrame, fraction: float = FRACTION, epochs: int = EPOCHS, seed: int = SEED, weights: dict[str, dict[str, float]] | None = None, digits: int | None = None) -> DataFrame:
    """docs + leaf columns mix_domain, mix_tokens, mix_budget and mix_copies: how many times the document is taken (0: not)."""
    weights = weights if weights is not None else {"domain": DOMAIN_WEIGHTS, "language": LANGUAGE_WEIGHTS, "source": SOURCE_WEIGHTS}
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"),
        "doc_id",
        (F.coalesce(F.col("domain").cast("string"), F.lit("")) if "domain" in docs.columns else F.concat(F.lit("d"), (F.expr("instr('0123456789abcdef', substring(md5(cast(coalesce(source, '') as binary)), 1, 1)) - 1") % DOMAINS).cast("string"))).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("language"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.regexp_count(text, F.lit(C.WORD)).cast("long").alias("tokens"),
        F.md5(text.cast("binary")).alias("tie"),
    )
    keyed = C.materialize(keyed, "mix-keys")  # words are counted once; some 100 bytes a document
    leaves = keyed.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    b = budgets(leaves, F.lit(float(fraction)) * F.col("all_tokens"), epochs, weights)
    b = b.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + F.lit(1e-9))).otherwise(0).cast("int"))
    b = b.withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("full") * F.col("tokens"))).withColumn("rest", F.when(F.col("rest") < 1e-6 * F.col("tokens"), 0.0).otherwise(F.col("rest")))
    b = C.materialize(b.select(*LEVELS, "budget", "full", "rest"), "mix-budgets")
    b = F.broadcast(b) if b.count() <= BROADCAST_LEAVES else b  # else a join by leaf, which the adaptive planner splits where one is hot
    if digits is None:
        digits, n = 1, keyed.count()
        while 16**digits * BUCKET_ROWS < n:
            digits += 1
    place = F.md5(F.concat(F.lit(f"{seed}:"), (F.col("full") + 1).cast("string"), F.lit(":"), F.col("id")).cast("binary"))
    rows = keyed.join(b, list(LEVELS)).withColumn("place", place).withColumn("bucket", F.substring("place", 1, digits))
    rows = rows.withColumn("cell", F.concat_ws("\x1f", *LEVELS, "bucket"))  # one key, or a partitioning by leaf would do for what follows
    sums = rows.groupBy("cell").agg(F.sum("tokens").alias("bucket_tokens"), *(F.first(c).alias(c) for c in (*LEVELS, "bucket")))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0))).select("cell", "ahead")
    inside = Window.partitionBy("cell").orderBy("place", "tie").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("cell", "place", "tie")
    rows = rows.join(sums, "cell")
    start = F.col("ahead") + F.sum("tokens").over(inside) - F.sum("tokens").over(same)
    picked = rows.withColumn("copies", F.col("full") + (start < F.col("rest")).cast("int"))
    return picked.select("doc_id", "tie", F.col("domain").alias("mix_domain"), F.col("language").alias("mix_language"), F.col("source").alias("mix_source"), F.col("tokens").alias("mix_tokens"), F.col("budget").alias("mix_budget"), F.col("copies").alias("mix_copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs' own rows and columns, each as many times as it is taken. Names added on the way are ones that docs doesn't have."""
    id_, tie, copies, n = C.free_names(docs, "mix_id", "mix_tie", "mix_copies", "mix_nth")
    key = select(docs, **how).where("mix_copies > 0").select(F.col("doc_id").alias(id_), F.col("tie").alias(tie), F.col("mix_copies").alias(copies)).dropDuplicates([id_, tie])
    out = docs.join(key, docs["doc_id"].eqNullSafe(key[id_]) & (F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")) == key[tie]))
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document with its leaf, tokens, the leaf's budget and how many times it is taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = select(docs)
    return out.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_language").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_budget", 3).alias("leaf_budget"), F.col("mix_copies").cast("long").alias("copies"))


def _deal(src: str, parent: str, level: str, w: str) -> str:
    """SQL of deal(): the closed form over one level."""
    over = f"PARTITION BY {parent}" if parent else ""
    on = " AND ".join(f"x.{c} = s.{c}" for c in [*(parent.split(", ") if parent else []), level])
    return f"""
x_{level} AS (SELECT {parent + ", " if parent else ""}{level}, sum(cap) AS cap, max({w}) AS w, max(up) AS up FROM {src} GROUP BY ALL),
y_{level} AS (SELECT *, cap / w AS fill,
  up - coalesce(sum(cap) OVER ({over} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
  sum(w) OVER ({over}) - coalesce(sum(w) OVER ({over} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wl FROM x_{level}),
z_{level} AS (SELECT *, fill * wl <= l AS is_full FROM y_{level}),
s_{level} AS (SELECT *, CASE WHEN is_full THEN cap ELSE
  (up - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({over}), 0)) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({over}) END AS budget FROM z_{level}),
t_{level} AS (SELECT x.* EXCLUDE (up), s.budget AS up FROM {src} x JOIN s_{level} s ON {on})"""


def _case(col: str, weights: dict[str, float]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1.0 END"


ORACLE = f"""
WITH k AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id,
    'd' || CAST((instr('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % {DOMAINS} AS VARCHAR) AS domain,
    coalesce(lang, '') AS language, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens, md5(coalesce(text, '')) AS tie FROM documents),
l0 AS (SELECT domain, language, source, sum(tokens) AS tokens, CAST(sum(tokens) AS DOUBLE) * {EPOCHS} AS cap,
    {_case("domain", DOMAIN_WEIGHTS)} AS wd, {_case("language", LANGUAGE_WEIGHTS)} AS wl, {_case("source", SOURCE_WEIGHTS)} AS ws FROM k GROUP BY ALL),
l1 AS (SELECT *, least({FRACTION} * CAST(sum(tokens) OVER () AS DOUBLE), sum(cap) OVER ()) AS up FROM l0),
{_deal("l1", "", "domain", "wd")}, {_deal("t_domain", "domain", "language", "wl")}, {_deal("t_language", "domain, language", "source", "ws")},
b AS (SELECT domain, language, source, tokens AS all_tokens, up AS budget, CASE WHEN tokens > 0 THEN floor(up / tokens + 1e-9) ELSE 0 END AS e FROM t_source),
c AS (SELECT *, CASE WHEN greatest(0, budget - e * all_tokens) < 1e-6 * all_tokens THEN 0 ELSE greatest(0, budget - e * all_tokens) END AS rest FROM b),
r AS (SELECT k.*, c.budget, c.e, c.rest, md5('{SEED}:' || CAST(CAST(c.e + 1 AS BIGINT) AS VARCHAR) || ':' || id) AS place FROM k JOIN c USING (domain, language, source)),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY place, tie)
    - sum(tokens) OVER (PARTITION BY domain, language, source, place, tie) AS start FROM r)
SELECT doc_id, domain, language AS lang, source, tokens AS n_tokens, round(budget, 3) AS leaf_budget,
    CAST(e AS BIGINT) + CASE WHEN start < rest THEN 1 ELSE 0 END AS copies FROM p
"""
