"""Repair of missing links between summaries and originals: by likeness, by time, by vectors, by declaration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_shared
from .retrieval import cosine, words


def token_set(c: Column) -> Column:
    """Distinct words of more than two characters."""
    return F.array_distinct(F.filter(words(c), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def jaccard_links(summaries: DataFrame, originals: DataFrame, threshold: float = 0.18) -> DataFrame:
    """Best original of each summary by Jaccard likeness, among those in its length band, at the threshold or above.

    Prefix filtering makes it an equi-join: with all words in one order, rarest first, two sets that reach the threshold share
    a word among the first ``n - ceil(threshold * n) + 1`` of each. Only those words are joined on, together with the length band, as
    lengths are cut into cells of a constant ratio. Words are numbered by the originals' vocabulary, so that sets are compared as numbers;
    a summary's other words only count for its size. (s_id, o_id, score)"""
    chars = 4 * F.col("n_tokens")
    low, high = F.greatest(F.lit(200), F.floor(0.5 * chars)), F.floor(1.6 * chars)
    cell = lambda n: F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(1.5))
    s = summaries.select(F.col("id").alias("s_id"), token_set(F.col("content")).alias("ws"), low.alias("low"), high.alias("high")).where((F.size("ws") > 0) & (F.col("high") >= F.col("low")))
    o = originals.select(F.col("id").alias("o_id"), token_set(F.col("content")).alias("ws"), F.length("content").alias("o_len")).where(F.size("ws") > 0)
    freq = o.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    freq = write_shared(freq.withColumn("wid", F.monotonically_increasing_id()), "words")

    def numbered(df: DataFrame, key: str, *carry: str) -> DataFrame:
        """(key, n, set, ordered, carried): a text's words by number, and rarest first."""
        rows = df.select(key, *carry, F.size("ws").alias("n"), F.explode("ws").alias("w")).join(freq, "w")
        of = rows.groupBy(key, "n", *carry).agg(F.array_sort(F.collect_list(F.struct("df", "wid"))).alias("x"))  # bounded by the text's own length
        return of.select(key, "n", *carry, F.col("x.wid").alias("ordered"))

    def prefix(df: DataFrame) -> Column:
        """The rarest words by which a text can be met; words nobody else has stand in front of them."""
        room = F.col("n") - F.ceil(threshold * F.col("n")) + 1 - (F.col("n") - F.size("ordered"))
        return F.slice("ordered", 1, F.greatest(F.lit(0), room).cast("int"))

    sn = write_shared(numbered(s, "s_id", "low", "high"), "summaries")
    on = write_shared(numbered(o, "o_id", "o_len"), "originals")
    s_words = sn.select("s_id", F.col("n").alias("s_n"), "low", "high", F.explode(prefix(sn)).alias("w")).select("*", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    o_words = on.select("o_id", F.col("n").alias("o_n"), "o_len", F.explode(prefix(on)).alias("w"), cell(F.col("o_len")).alias("cell"))
    sizes = (F.col("s_n") >= F.ceil(threshold * F.col("o_n"))) & (F.col("o_n") >= F.ceil(threshold * F.col("s_n")))
    band = F.col("o_len").between(F.col("low"), F.col("high"))
    cand = s_words.join(o_words, ["w", "cell"]).where(sizes & band).select("s_id", "o_id").distinct()
    sets = cand.join(sn.select("s_id", F.col("n").alias("s_n"), F.col("ordered").alias("s_set")), "s_id").join(on.select("o_id", F.col("n").alias("o_n"), F.col("ordered").alias("o_set")), "o_id")
    both = F.size(F.array_intersect("s_set", "o_set"))
    scored = sets.withColumn("both", both).withColumn("score", F.round(F.col("both") / (F.col("s_n") + F.col("o_n") - F.col("both")), 6)).where(F.col("score") >= threshold)
    return scored.groupBy("s_id").agg(F.max(F.struct("score", (-F.col("o_id")).alias("neg"))).alias("b")).select("s_id", (-F.col("b.neg")).alias("o_id"), F.col("b.score").alias("score"))


def asof_links(summaries: DataFrame, originals: DataFrame, window_s: int, linked: DataFrame | None = None) -> DataFrame:
    """Latest original in the window before each summary, among those not yet linked. (s_id, o_id, lag_us)

    One pass over the union in order of time within buckets of the window's width: a summary looks at its own bucket and the
    one before, so no range join and no global sort is needed."""
    if linked is not None:
        originals = originals.join(linked.select(F.col("o_id").alias("id")), "id", "left_anti")
    w_us = window_s * 1_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    o = originals.select(F.col("id").alias("o_id"), us.alias("o_us"), F.explode(F.array(F.floor(us / w_us), F.floor(us / w_us) + 1)).alias("cell"))
    s = summaries.select(F.col("id").alias("s_id"), us.alias("s_us"), F.floor(us / w_us).alias("cell"))
    both = s.select("cell", F.col("s_us").alias("us"), F.lit(1).alias("kind"), "s_id", F.lit(None).cast("bigint").alias("o_id")).unionByName(
        o.select("cell", F.col("o_us").alias("us"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("s_id"), "o_id")
    )
    order = Window.partitionBy("cell").orderBy("us", "kind", F.desc_nulls_first("o_id")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("us", "o_id")), ignorenulls=True).over(order)
    hit = both.withColumn("hit", last).where("kind = 1 and hit is not null")
    return hit.select("s_id", F.col("hit.o_id").alias("o_id"), (F.col("us") - F.col("hit.us")).alias("lag_us")).where(F.col("lag_us") <= w_us)


def vector_links(summaries: DataFrame, originals: DataFrame, hours: float, threshold: float, delta: float, quota: int = 200) -> DataFrame:
    """Best original by cosine within ``hours`` of each summary, the same app first (half the quota); with second score, their
    difference and status (ok, below_threshold, below_delta).

    An interval join on cells of twice the span: each original is put into the cells it can be met in."""
    span = int(hours * 3_600_000_000)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    s = summaries.select(F.col("id").alias("s_id"), us.alias("s_us"), F.col("app").alias("s_app"), F.col("embedding").alias("s_vec"), F.floor(us / (2 * span)).alias("cell"))
    cells = F.array_distinct(F.array(F.floor((us - span) / (2 * span)), F.floor((us + span) / (2 * span))))
    o = originals.select(F.col("id").alias("o_id"), us.alias("o_us"), F.col("app").alias("o_app"), F.col("embedding").alias("o_vec"), F.explode(cells).alias("cell"))
    near = s.join(o, "cell").where(F.abs(F.col("s_us") - F.col("o_us")) <= span).withColumn("same", (F.col("s_app") == F.col("o_app")).cast("int"))
    take = Window.partitionBy("s_id", "same").orderBy(F.abs(F.col("s_us") - F.col("o_us")), "o_id")
    near = near.withColumn("r", F.row_number().over(take)).where(F.col("r") <= F.when(F.col("same") == 1, quota // 2).otherwise(quota))
    scored = near.withColumn("score", F.round(cosine(F.col("s_vec"), F.col("o_vec")), 6))
    w = Window.partitionBy("s_id").orderBy(F.desc("score"), "o_id")
    best = scored.withColumns({"rank": F.row_number().over(w), "second_score": F.coalesce(F.lead("score").over(w), F.lit(0.0)), "num_candidates": F.count("*").over(Window.partitionBy("s_id"))}).where("rank = 1")
    diff = F.round(F.col("score") - F.col("second_score"), 6)
    status = F.when(F.col("score") < threshold, "below_threshold").when((F.col("num_candidates") > 1) & (diff < delta), "below_delta").otherwise("ok")
    return best.select("s_id", "o_id", "score", "second_score", diff.alias("delta_diff"), "num_candidates", status.alias("status"))


def declared_links(summaries: DataFrame, originals: DataFrame) -> DataFrame:
    """Originals that a summary's metadata names, by app id before id. (s_id, o_id, by)"""
    s = summaries.select(F.col("id").alias("s_id"), F.get_json_object("metadata", "$.original_app_id").alias("app"), F.get_json_object("metadata", "$.original_id").alias("key"))
    by_app = originals.where("app_id is not null").groupBy(F.col("app_id").alias("app")).agg(F.min("id").alias("a_id"))
    by_id = originals.select(F.col("id").cast("string").alias("key"), F.col("id").alias("k_id")).distinct()
    both = s.join(by_app, "app", "left").join(by_id, "key", "left")
    return both.select("s_id", F.coalesce("a_id", "k_id").alias("o_id"), F.when(F.col("a_id").isNotNull(), "app_id").when(F.col("k_id").isNotNull(), "id").alias("by")).where("o_id is not null")


def weave(summaries: DataFrame, originals: DataFrame, run_id: str, hours: float = 24, threshold: float = 0.3, delta: float = 0.02, batch: int = 0, batches: int = 1, idle_s: int | None = None) -> DataFrame:
    """One run of link repair over a batch of the summaries: audit rows (run_id, s_id, o_id, method, score, status).

    A summary gets the original nearest by vector; where that is unsure, the latest one before it. ``batch`` of ``batches`` is cut by a hash of
    the id. ``idle_s``: seconds since the user was last active; under 300 the run does nothing."""
    s = summaries.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == batch)
    if idle_s is not None and idle_s < 300:
        s = s.where(F.lit(False))
    by_vector = vector_links(s, originals, hours, threshold, delta)
    by_time = asof_links(s, originals, int(hours * 3600)).select("s_id", F.col("o_id").alias("t_id"))
    both = s.select(F.col("id").alias("s_id")).join(by_vector, "s_id", "left").join(by_time, "s_id", "left")
    sure = F.coalesce(F.col("status") == "ok", F.lit(False))
    method = F.when(sure, "vector").when(F.col("t_id").isNotNull(), "timestamp").otherwise("none")
    return both.select(
        F.lit(run_id).alias("run_id"), "s_id", F.when(sure, F.col("o_id")).otherwise(F.col("t_id")).alias("o_id"), method.alias("method"), F.when(sure, F.col("score")).alias("score"),
        F.when(sure, "ok").when(F.col("t_id").isNotNull(), F.coalesce("status", F.lit("no_candidate"))).otherwise("unlinked").alias("status"),
    )


def rollback(edges: DataFrame, undone: DataFrame, *on: str) -> DataFrame:
    """Edges without those of the undone runs, or the undone pairs."""
    return edges.join(undone.select(*on).distinct(), list(on), "left_anti")


def verify_edges(audit: DataFrame, edges: DataFrame, *on: str) -> DataFrame:
    """Committed audit rows, each with whether its edge is there."""
    there = edges.select(*on).distinct().withColumn("found", F.lit(True))
    return audit.join(there, list(on), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def upsert_entities(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities by lower-case name, edges) of mention rows (id, name, type)."""
    m = mentions.where(F.trim("name") != "").withColumn("key", F.lower(F.trim("name")))
    nodes = m.groupBy("key").agg(F.min("name").alias("name"), F.min("type").alias("type"))
    return nodes, m.select("id", "key").distinct()


def interpolate_dates(df: DataFrame, series: str, pos: str, ts: str, first: str, last: str) -> DataFrame:
    """Missing times of a series filled linearly between the known ones around; its ends are forced where unknown."""
    w = Window.partitionBy(series)
    at_first, at_last = F.col(pos) == F.min(pos).over(w), F.col(pos) == F.max(pos).over(w)
    known = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.when(at_first, F.unix_micros(F.lit(first).cast("timestamp"))), F.when(at_last, F.unix_micros(F.lit(last).cast("timestamp"))))
    df = df.withColumn("_k", known)
    back, fwd = Window.partitionBy(series).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(series).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("_k").isNotNull(), F.struct(F.col("_k").alias("t"), F.col(pos).alias("p")))
    df = df.withColumns({"_a": F.last(point, True).over(back), "_b": F.first(point, True).over(fwd)})
    step = F.when(F.col("_b.p") > F.col("_a.p"), (F.col(pos) - F.col("_a.p")) / (F.col("_b.p") - F.col("_a.p"))).otherwise(0.0)
    us = F.round(F.col("_a.t") + (F.col("_b.t") - F.col("_a.t")) * step).cast("bigint")
    return df.withColumns({"filled_us": us, "is_estimated": F.col(ts).isNull()}).drop("_k", "_a", "_b")
