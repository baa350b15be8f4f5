"""Evaluation of rankings by group: rates, document summaries, predeclared gates, labels of what changed, router accuracy.

A result is a row a question: query_id, its groups, and booleans such as any_5, all_5, law_1; ranked slots are rows
(query_id, rank, key, document). Groups whose value is NULL are no group; a rate over nothing is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T

CUTOFFS = (1, 3, 5)


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def checked_ranks(ranking: DataFrame) -> DataFrame:
    """ranking, or an error where a question's ranks aren't 1, 2, 3, ... without gap and repeat."""
    w = Window.partitionBy("query_id").orderBy("rank")
    bad = F.col("rank") != F.row_number().over(w)
    return ranking.withColumn("rank", F.when(bad, F.raise_error(F.concat(F.lit("ranks are not sequential: "), F.col("query_id").cast("string"))).cast("int")).otherwise(F.col("rank")))


def question_type(keys: Column) -> Column:
    """annex, article or mixed, by the expected source keys."""
    annex = F.size(F.filter(keys, lambda k: k.contains("/annex/")))
    return F.when(annex == F.size(keys), "annex").when(annex > 0, "mixed").otherwise("article")


def is_multi_source(keys: Column) -> Column:
    return F.size(F.array_distinct(keys)) > 1


def needs_review(status: Column, missing: Column, cited: Column, multi: Column, complete: Column) -> Column:
    """Whether a person should look first: insufficient, nothing expected was retrieved, retrieved but not cited, or an incomplete answer from several sources."""
    return missing | (status == "YETERSIZ") | (~missing & ~cited) | (multi & ~complete)


def law_metrics(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """ranking(query_id, rank, key, law), gold(query_id, key, law) -> a row a question: any_k, all_k, law_k, share_5, top_law, unexpected_top.

    share_5: of the first five slots whose law is known, those of laws that aren't expected; NULL without any.
    """
    g = gold.groupBy("query_id").agg(F.collect_set("key").alias("keys"), F.collect_set("law").alias("laws"))
    r = ranking.where("rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "law"))).alias("s"))
    j = g.join(r, "query_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<rank:int,key:string,law:string>>")))
    top = lambda k, f: F.transform(F.filter("s", lambda x: x["rank"] <= k), lambda x: x[f])
    out = [F.col("query_id")]
    for k in CUTOFFS:
        keys = top(k, "key")
        out += [F.arrays_overlap("keys", keys).alias(f"any_{k}"), (F.size(F.array_except("keys", keys)) == 0).alias(f"all_{k}"), F.coalesce(F.arrays_overlap("laws", F.array_compact(top(k, "law"))), F.lit(False)).alias(f"law_{k}")]
    known = F.array_compact(top(5, "law"))
    odd = F.size(F.filter(known, lambda x: ~F.array_contains("laws", x)))
    first = F.get(F.transform(F.filter("s", lambda x: x["rank"] == 1), lambda x: x["law"]), F.lit(0))
    return j.select(*out, F.when(F.size(known) > 0, odd / F.size(known)).alias("share_5"), first.alias("top_law"), (~F.array_contains("laws", first)).alias("unexpected_top"))


RATES = tuple(f"{name}_{k}" for name in ("any", "all", "law") for k in CUTOFFS)


def rates(results: DataFrame, *by: str) -> DataFrame:
    """The nine rates, unexpected top laws (count and share of the known), the mean share_5 and questions, and errors where rows tell of them, by group or over all."""
    rows = results
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    sums = [F.count("*").alias("questions"), *(share(F.col(c)).alias(c) for c in RATES), F.count_if("unexpected_top").alias("unexpected_tops"), (F.count_if("unexpected_top") / F.nullif(F.count("top_law"), F.lit(0))).alias("unexpected_top_rate"), F.avg("share_5").alias("mean_share_5"), *([F.count("error").alias("errors")] if "error" in rows.columns else [])]
    return rows.groupBy(*by).agg(*sums)


def document_summary(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """scored: metrics.at_cutoffs()'s rows; gold(query_id, key, document) -> group, k, questions, rates, mean intrusion, questions where that is defined and isn't.

    Groups: overall; document:D of each gold document (a question of several counts in each);
    single_source, multi_source, single_document, multi_document, of zero questions too.
    """
    g = gold.groupBy("query_id").agg(F.countDistinct("key").alias("n_keys"), F.collect_set(F.col("document").cast("string")).alias("documents"))
    named = F.concat(
        F.array(F.lit("overall"), F.when(F.col("n_keys") == 1, "single_source").otherwise("multi_source"), F.when(F.size("documents") == 1, "single_document").otherwise("multi_document")),
        F.transform("documents", lambda d: F.concat(F.lit("document:"), d)),
    )
    rows = scored.join(g, "query_id").select("*", F.explode(named).alias("group"))
    fixed = scored.sparkSession.createDataFrame([(x, k) for x in ("overall", "single_source", "multi_source", "single_document", "multi_document") for k in CUTOFFS], "group string, k int")
    flags = ("source_any", "source_all", "document_hit", "document_all")
    made = rows.groupBy("group", "k").agg(F.count("*").alias("questions"), *(share(F.col(c)).alias(c) for c in flags), F.avg("intrusion").alias("intrusion"), F.count("intrusion").alias("defined"), F.count_if(F.col("intrusion").isNull()).alias("undefined"))
    return made.join(fixed, ["group", "k"], "full_outer").fillna(0, ["questions", "defined", "undefined"])


def gates(old: DataFrame, new: DataFrame, preserved: str, improved: str) -> DataFrame:
    """old, new (query_id, dataset, n_keys, any_5, all_5, law_1) -> gate, holds: six predeclared gates and the decision.

    A: neither count falls on the preserved dataset. B: on the improved one a count rises and none falls by more than
    one. C: all_5 doesn't fall over all. D: law_1 falls by one at most. E: all_5 of questions with several sources
    doesn't fall (holds where there are none). F: nothing was generated, which is so by construction.
    """
    n = lambda flag, where: F.count_if(F.col(flag) & where)
    p, i, every, many = F.col("dataset") == preserved, F.col("dataset") == improved, F.lit(True), F.col("n_keys") > 1
    named = {"a_any": n("any_5", p), "a_all": n("all_5", p), "b_any": n("any_5", i), "b_all": n("all_5", i), "c_all": n("all_5", every), "d_law": n("law_1", every), "e_all": n("all_5", many)}
    o, w = (df.agg(F.struct(*(c.alias(k) for k, c in named.items())).alias(side)) for df, side in ((old, "o"), (new, "w")))
    both = o.crossJoin(F.broadcast(w))  # one row each
    d = lambda c: F.col(f"w.{c}") - F.col(f"o.{c}")
    held = {"A": (d("a_any") >= 0) & (d("a_all") >= 0), "B": ((d("b_any") > 0) | (d("b_all") > 0)) & (d("b_any") >= -1) & (d("b_all") >= -1), "C": d("c_all") >= 0, "D": d("d_law") >= -1, "E": d("e_all") >= 0, "F": F.lit(True)}
    every_one = F.lit(True)
    for c in held.values():
        every_one = every_one & c
    rows = F.array(*(F.struct(F.lit(k).alias("gate"), c.alias("holds")) for k, c in held.items()), F.struct(F.lit("VALIDATED").alias("gate"), every_one.alias("holds")))
    return both.select(F.inline(rows))


def recommend(summary: DataFrame, baseline: str, preserved: str, improved: str) -> DataFrame:
    """summary(strategy, position, scope, any_5, all_5, law_1) -> strategy, eligible, recommended.

    Scopes: the preserved and the improved dataset, 'combined', 'multi_part' and 'single_source'. A strategy is eligible if
    neither rate falls on the preserved dataset, both rise on the improved one, law_1 doesn't fall over all, all_5 of
    multi-part questions rises and any_5 of single-source ones doesn't fall. Of the eligible the best all_5, then
    any_5 on the improved dataset, then the first by position is recommended; there may be none.
    """
    base = summary.where(F.col("strategy") == baseline).select("scope", *(F.col(c).alias(f"b_{c}") for c in ("any_5", "all_5", "law_1")))
    j = summary.where(F.col("strategy") != baseline).join(F.broadcast(base), "scope")  # a row a scope
    up, same = (lambda c: F.col(c) > F.col(f"b_{c}")), (lambda c: F.col(c) >= F.col(f"b_{c}"))
    s = F.col("scope")
    fine = F.when(s == preserved, same("any_5") & same("all_5")).when(s == improved, up("any_5") & up("all_5")).when(s == "combined", same("law_1")).when(s == "multi_part", up("all_5")).when(s == "single_source", same("any_5"))
    mine = lambda c: F.max(F.when(s == improved, F.col(c)))
    out = j.groupBy("strategy", "position").agg(((F.count_if(fine) == 5) & (F.countDistinct("scope") == 5)).alias("eligible"), mine("all_5").alias("all_5"), mine("any_5").alias("any_5"))
    best = F.row_number().over(Window.partitionBy("eligible").orderBy(F.desc("all_5"), F.desc("any_5"), "position"))
    return out.select("strategy", "eligible", (F.col("eligible") & (best == 1)).alias("recommended"))


def changes(old: DataFrame, new: DataFrame, gold: DataFrame) -> DataFrame:
    """old, new (query_id, rank, id, key, law) and gold(query_id, key, law) -> query_id, labels (overlapping, in a fixed order).

    HYBRID RECOVERY, DENSE EVIDENCE DISPLACEMENT: at 1, 3 or 5 the new or the old ranking covers a gold key that the
    other doesn't. MULTI-SOURCE COMPLETENESS LOSS, GAIN: of questions with several keys, all_5 lost or won. CROSS-LAW
    INTRUSION: an id that is new, of a known law that isn't expected. BENIGN REORDERING: none of these, other order.
    """
    g = gold.groupBy("query_id").agg(F.collect_set("key").alias("keys"), F.collect_set("law").alias("laws"))
    side = lambda df, n: df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "key", "law"))).alias(n))
    j = g.join(side(old, "o"), "query_id", "left").join(side(new, "w"), "query_id", "left")
    covered = lambda c, k: F.array_intersect("keys", F.transform(F.filter(c, lambda x: x["rank"] <= k), lambda x: x["key"]))
    more = lambda a, b: F.greatest(*(F.size(F.array_except(covered(a, k), covered(b, k))) for k in CUTOFFS)) > 0
    whole = lambda c: F.size(covered(c, 5)) == F.size("keys")
    many = F.size("keys") > 1
    ids = lambda c: F.transform(c, lambda x: x["id"])
    odd = F.exists("w", lambda x: ~F.array_contains(ids("o"), x["id"]) & x["law"].isNotNull() & ~F.array_contains("laws", x["law"]))
    found = F.array_compact(F.array(
        F.when(more("w", "o"), "HYBRID RECOVERY"),
        F.when(more("o", "w"), "DENSE EVIDENCE DISPLACEMENT"),
        F.when(many & whole("o") & ~whole("w"), "MULTI-SOURCE COMPLETENESS LOSS"),
        F.when(many & ~whole("o") & whole("w"), "MULTI-SOURCE COMPLETENESS GAIN"),
        F.when(odd, "CROSS-LAW INTRUSION"),
    ))
    return j.select("query_id", F.when((F.size(found) == 0) & (ids("o") != ids("w")), F.array(F.lit("BENIGN REORDERING"))).otherwise(found).alias("labels"))


def oracle_labels(g0: Column, o1: Column, o2: Column, o3: Column) -> Column:
    """What a source's rank says in four searches: global, within its document, enriched, both. NULL: not among those searched."""
    return F.array_compact(F.array(
        F.when(g0.isNull() & (o1 <= 10), "document_competition"),
        F.when(o1 > 10, "within_document_difficulty"),
        F.when(o2.isNotNull() & (g0.isNull() | (o2 < g0)), "enriched_global_improves"),
        F.when(o3 < o1, "enrichment_improves_within"),
        F.when(o3 > o1, "enrichment_worsens_within"),
        F.when((o1 > 20) & (o3 > 20), "persistent_poor_rank"),
    ))


def routing_cost(base: str, one: str, two: str) -> Column:
    """Labels of a wrong first route from three results (structs with source_any, source_all)."""
    b, r1, r2 = F.col(base), F.col(one), F.col(two)
    lost = (b["source_any"] & ~r1["source_any"]) | (b["source_all"] & ~r1["source_all"])
    back = (~r1["source_any"] & r2["source_any"]) | (~r1["source_all"] & r2["source_all"])
    return F.array_compact(F.array(
        F.when(lost, "catastrophic"),
        F.when(back, "recovered_by_second"),
        F.when(~b["source_any"] & ~b["source_all"], "already_wrong"),
        F.when((b["source_any"] == r1["source_any"]) & (b["source_all"] == r1["source_all"]), "no_impact"),
    ))


def route_accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """rows(gold, prediction array, ...) -> questions, valid, top1, top2 and their shares of all questions, failures."""
    hit = lambda k: F.count_if(F.array_contains(F.slice("prediction", 1, k), F.col("gold")))
    valid = F.count_if(F.coalesce(F.size("prediction") > 0, F.lit(False)))
    n = F.count("*")
    return rows.groupBy(*by).agg(n.alias("questions"), valid.alias("valid"), hit(1).alias("top1"), hit(2).alias("top2"), (hit(1) / n).alias("top1_accuracy"), (hit(2) / n).alias("top2_accuracy"), (n - valid).alias("failures"))


def routing_confusion(rows: DataFrame, documents: list) -> DataFrame:
    """gold, predicted, n over the whole grid of documents, by first predictions."""
    grid = rows.sparkSession.createDataFrame([(a, b) for a in documents for b in documents], rows.select(F.col("gold"), F.col("gold").alias("predicted")).schema)
    made = rows.where(F.size("prediction") > 0).groupBy("gold", F.col("prediction")[0].alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(made, ["gold", "predicted"], "left").fillna(0, ["n"])


def routers_compared(a: DataFrame, b: DataFrame, cutoff: int) -> DataFrame:
    """a, b (query_id, gold, prediction) of two routers -> query_id, outcome: both_correct, first_only, second_only, both_wrong."""
    hit = lambda df, n: df.select("query_id", F.coalesce(F.array_contains(F.slice("prediction", 1, cutoff), F.col("gold")), F.lit(False)).alias(n))
    j = hit(a, "x").join(hit(b, "y"), "query_id")
    return j.select("query_id", F.when(F.col("x") & F.col("y"), "both_correct").when(F.col("x"), "first_only").when(F.col("y"), "second_only").otherwise("both_wrong").alias("outcome"))


def source_ranks(distances: DataFrame, gold: DataFrame) -> DataFrame:
    """distances(query_id, id, key, document, distance) of all of a question's gold documents' chunks -> query_id, key, rank, candidates: where each gold key stands first when everything in its document is ranked."""
    inside = distances.join(gold.select("query_id", "document").distinct(), ["query_id", "document"], "left_semi")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    r = inside.withColumn("rank", F.row_number().over(w)).withColumn("candidates", F.count("*").over(Window.partitionBy("query_id")))
    first = r.groupBy("query_id", "key").agg(F.min("rank").alias("rank"), F.max("candidates").alias("candidates"))
    return gold.select("query_id", "key").distinct().join(first, ["query_id", "key"], "left")


#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"


def best_lines(asked: DataFrame, chunks: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """asked(query_id, question, id), chunks(id, text) -> query_id, id, line_no (from 1), line, shared: the line of the chunk with the most distinct tokens of the question (but those in stop), the first of those; none is shared: the first line.

    Lines meet questions by chunk and token; a row a shared token is what is joined, and each task takes its own maxima first. A text without lines gives no row.
    """
    lines = chunks.where("text <> ''").select("id", F.posexplode(F.split(F.regexp_replace("text", f"({LINE_END})\\z", ""), LINE_END, -1)).alias("n", "line"))
    ask = asked.select("query_id", "id", F.explode(F.array_except(F.array_distinct(T.tokens("question")), F.array(*map(F.lit, stop)).cast("array<string>"))).alias("token"))
    wanted = ask.select("id", "token").distinct()
    has = lines.select("id", "n", F.explode(F.array_distinct(T.tokens("line"))).alias("token")).join(wanted, ["id", "token"])
    hits = has.join(ask, ["id", "token"]).groupBy("query_id", "id", "n").agg(F.array_sort(F.collect_list("token")).alias("shared"))
    top = hits.groupBy("query_id", "id").agg(F.max_by(F.struct("n", "shared"), F.struct(F.size("shared"), -F.col("n"))).alias("top"))
    j = asked.select("query_id", "id").join(top, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("top.n", F.lit(0)).alias("n"), F.coalesce("top.shared", F.array().cast("array<string>")).alias("shared"))
    return j.join(lines, ["id", "n"]).select("query_id", "id", (F.col("n") + 1).alias("line_no"), "line", "shared")


def term_comparison(question: Column, right: Column, wrong: Column) -> list[Column]:
    """Tokens of a question in the right and in the wrong source: overlapping, only in the right one, in the wrong one, only in the wrong one; each in order."""
    q, r, w = (F.array_distinct(T.tokens(c)) for c in (question, right, wrong))
    both = F.array_intersect
    made = {"overlapping": both(both(q, r), w), "only_right": F.array_except(both(q, r), w), "favour_wrong": both(q, w), "only_wrong": F.array_except(both(q, w), r)}
    return [F.array_sort(c).alias(n) for n, c in made.items()]
