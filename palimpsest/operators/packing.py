"""Context packing under a budget, and snippets around literal matches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.query import wants_recent

MONTH_S = 30 * 86_400


def mixed_score(df: DataFrame, query: str, now: str, score: str = "score", ts: str = "ts") -> DataFrame:
    """``mixed``: relevance and recency, weighted by whether the query asks for what is recent. ``now``: a timestamp text."""
    relevance, recency = (0.4, 0.6) if wants_recent(query) else (0.7, 0.3)
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6)
    fresh = F.greatest(F.lit(0.0), 1 - age / MONTH_S)
    return df.withColumn("mixed", F.round(relevance * F.col(score) + recency * F.coalesce(fresh, F.lit(0.0)), 6))


def pack(df: DataFrame, token_budget: int, by: str = "query_id", key: str = "id", text: str = "content") -> DataFrame:
    """Rows that fit 95 % of the budget (four characters a token), best first; the first that doesn't fit is cut or left out.

    A cut ends at the last sentence end past the middle of what is left, else anywhere; under 200 characters nothing is cut.
    Adds ``packed`` and ``position``; results of one query are few (the anchors and their walk), so the window is small."""
    budget = int(token_budget * 0.95) * 4
    w = Window.partitionBy(by).orderBy(F.desc("mixed"), key)
    n = F.length(text)
    total = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"_n": n, "_total": total, "_rank": F.row_number().over(w)})
    df = df.withColumn("_over", F.min(F.when(F.col("_total") > budget, F.col("_rank"))).over(Window.partitionBy(by)))
    left = F.lit(budget) - (F.col("_total") - F.col("_n"))
    head = F.substring(F.col(text), F.lit(1), left)
    cut = F.length(head) - F.length(F.regexp_extract(head, r"[^.!?\n]*$", 0))  # characters up to and with the last end
    sliced = F.when(cut - 1 > left * 0.5, F.concat(F.substring(F.col(text), F.lit(1), cut), F.lit(" [Truncated]"))).otherwise(F.concat(head, F.lit("...")))
    fits = F.col("_over").isNull() | (F.col("_rank") < F.col("_over"))
    packed = F.when(fits, F.col(text)).when((F.col("_rank") == F.col("_over")) & (left > 200), sliced)
    out = df.withColumn("packed", packed).where("packed is not null")
    return out.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("ts", key))).drop("_n", "_total", "_rank", "_over")


def prompt(packed: DataFrame, by: str = "query_id") -> DataFrame:
    """One text per query: the packed rows in order of time, each under its source."""
    part = F.concat(F.lit("[Source: "), F.coalesce("source", F.lit("")), F.lit("] ("), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(")\n"), "packed")
    rows = packed.select(by, F.struct("position", part.alias("part"), F.length("packed").alias("n")).alias("r"))
    return rows.groupBy(by).agg(F.array_sort(F.collect_list("r")).alias("rs")).select(by, F.array_join(F.col("rs.part"), "\n\n").alias("prompt"), F.aggregate("rs.n", F.lit(0), lambda a, x: a + x).alias("n_chars"))


def elastic_windows(docs: DataFrame, needles: list[str], budget: int, key: str = "id", text: str = "content", gap: int = 50) -> DataFrame:
    """(id, start, end, snippet) around every literal match; windows shrink with the number of matches, near ones merge."""
    pattern = "(?i)" + "|".join(re.escape(n) for n in needles)
    pieces = F.split(F.col(text), pattern, -1)
    found = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
    hits = docs.where(F.col(text).rlike(pattern)).select(key, text, pieces.alias("p"), found.alias("f"), F.size(found).alias("m"))
    total = hits.agg(F.sum("m").alias("hits")).first().hits or 1
    hits = hits.withColumn("w", F.lit(max(300, min(1500, budget // total))))
    lens = F.zip_with(F.slice("p", 1, F.col("m")), "f", lambda p, f: F.struct(F.length(p).alias("a"), F.length(f).alias("b")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("xs"))
    walk = F.aggregate(lens, zero, lambda acc, x: F.struct((acc.at + x.a + x.b).alias("at"), F.concat(acc.xs, F.array(F.struct((acc.at + x.a).alias("s"), (acc.at + x.a + x.b).alias("e")))).alias("xs")))
    spots = hits.select(key, F.length(text).alias("n"), "w", F.explode(walk.xs).alias("x"))
    half = (F.col("w") / 2).cast("int")
    ranges = spots.select(key, F.greatest(F.lit(0), F.col("x.s") - half).alias("s"), F.least(F.col("n"), F.col("x.e") + half).alias("e"))
    w = Window.partitionBy(key).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") <= before + gap, 0).otherwise(1)).over(w)
    merged = ranges.withColumn("island", island).groupBy(key, "island").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    return merged.join(docs.select(key, text), key).select(key, "start", "end", F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")).alias("snippet"))


def snippet_context(windows: DataFrame, docs: DataFrame, budget: int, key: str = "id") -> DataFrame:
    """(position, entry): headers and snippets in order of the documents' scores until the budget is full.

    ``windows``: of ``elastic_windows``; ``docs``: (key, source, score). What follows the first entry that doesn't fit is left out. The
    hits of one request are few: their running length is one window."""
    w = windows.join(docs.select(key, "source", "score"), key)
    head = w.groupBy(key, "source", "score").agg(F.lit(-1).alias("start")).withColumn("entry", F.concat(F.lit("### Source: "), F.coalesce("source", F.lit("")), F.lit(" (Score: "), F.round("score").cast("bigint"), F.lit(")\n")))
    body = w.select(key, "source", "score", "start", F.concat(F.lit("..."), F.regexp_replace("snippet", "\n", " "), F.lit("...\n\n")).alias("entry"))
    order = Window.orderBy(F.desc("score"), key, "start")
    rows = head.select(key, "score", "start", "entry").unionByName(body.select(key, "score", "start", "entry"))
    total = F.sum(F.length("entry")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"position": F.row_number().over(order), "_total": total}).where(F.col("_total") <= budget).select("position", key, "entry")
