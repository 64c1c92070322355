"""Upkeep of a memory table: time tags, keyword infection, discovery, episodes, quarantine, verified writes, hygiene."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.kernels import app_id
from ..functions.query import STOP

# Bucket names that say nothing.
GENERIC = ("core", "misc", "general", "other", "unknown")
UNSPECIFIC = (*GENERIC, "pending", "inbox")
PLACEHOLDER = "semantic_tag_placeholder"
QUARANTINE_TAGS = ("#manually_quarantined", "#auto_quarantined")


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _names(xs: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def needs_dream(buckets: str = "buckets", ts: str = "ts") -> Column:
    """No bucket, only generic ones, or not the row's year."""
    b = _list(buckets)
    return (F.size(F.array_except(b, _names(GENERIC))) == 0) | ~F.array_contains(b, F.year(ts).cast("string"))


def dream(df: DataFrame, buckets: str = "buckets", ts: str = "ts") -> DataFrame:
    """Rows that need it get their time tags, a placeholder if they have fewer than two meaningful buckets, and lose the
    unspecific buckets if a specific one remains. Adds ``new_buckets``; other rows keep theirs."""
    b = _list(buckets)
    meaningful = F.filter(F.array_distinct(b), lambda x: ~x.isin("core", "pending") & ~x.rlike(r"^\d{4}$"))
    extra = F.when(F.size(meaningful) < 2, F.array(F.lit(PLACEHOLDER))).otherwise(F.array().cast("array<string>"))
    joined = F.array_distinct(F.concat(b, extra, X.temporal_tags(F.col(ts))))
    specific = F.array_except(joined, _names(UNSPECIFIC))
    fresh = F.when(F.size(specific) > 0, specific).otherwise(joined)
    return df.withColumn("new_buckets", F.when(F.col(ts).isNotNull() & needs_dream(buckets, ts), fresh).otherwise(b))


def infect(df: DataFrame, keywords: Sequence[str], tags: str = "tags", text: str = "content") -> DataFrame:
    """(.., new_tags): only the rows that the keywords, years or months of their text change."""
    new = X.infect(F.col(tags), F.col(text), keywords)
    return df.withColumn("new_tags", new).where(F.size("new_tags") > F.size(F.array_distinct(_list(tags))))


def discover(df: DataFrame, known: DataFrame, text: str = "content") -> DataFrame:
    """Entity names of the texts that no known keyword equals, whatever the case: (name, n)."""
    stop = ("The", "And", "For", "This")  # fixed values
    found = df.select(F.explode(X.entities(F.col(text))).alias("name")).where((F.length("name") > 2) & ~F.col("name").isin(*stop))
    names = found.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.count("*").alias("n"))
    return names.join(known.select(F.lower("keyword").alias("key")).distinct(), "key", "left_anti").select("name", "n")


def grown_keywords(known: DataFrame, found: DataFrame) -> DataFrame:
    """The keyword table with the discovered names in it: (keyword), each once whatever its case; a known spelling stays."""
    new = found.select(F.col("name").alias("keyword")).join(known.select(F.lower("keyword").alias("key")).distinct(), F.lower(F.col("keyword")) == F.col("key"), "left_anti")
    return known.select("keyword").distinct().unionByName(new.groupBy(F.lower("keyword").alias("k")).agg(F.min("keyword").alias("keyword")).select("keyword"))


def seed_sample(df: DataFrame, seed: int, k: int, key: str = "id", holding: str | None = None, text: str = "content") -> DataFrame:
    """``k`` rows in an order that only the seed and the key decide; with ``holding``, of those whose text holds that word."""
    rows = df if holding is None else df.where(F.lower(text).contains(holding.lower()))
    return rows.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("draw", key).limit(k).drop("draw")


def keyset_page(df: DataFrame, key: str, after, k: int) -> DataFrame:  # noqa: ANN001
    """The next ``k`` rows in order of the key; ``after``: the last key of the page before (None: the first page)."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(k)


def keyset_pages(df: DataFrame, key: str, k: int) -> Iterator[DataFrame]:
    """Pages of ``k`` rows until the table ends; each is a top-k of its own, and only its last key reaches the driver."""
    after = None
    while True:
        page = keyset_page(df, key, after, k)
        last = page.agg(F.max(key)).first()[0]
        if last is None:
            return
        yield page
        after = last


def point_lookup(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """Rows of the given keys: a filter that the scan takes in."""
    return df.where(F.col(key).isin(list(values)))


def quarantine(df: DataFrame, which: Column) -> DataFrame:
    tags = F.array_union(_list("tags"), F.array(F.lit("#manually_quarantined")))
    return df.withColumns({"tags": F.when(which, tags).otherwise(_list("tags")), "provenance": F.when(which, "quarantine").otherwise(F.col("provenance"))})


def restore(df: DataFrame, which: Column) -> DataFrame:
    tags = F.array_except(_list("tags"), _names(QUARANTINE_TAGS))
    return df.withColumns({"tags": F.when(which, tags).otherwise(_list("tags")), "provenance": F.when(which, "internal").otherwise(F.col("provenance"))})


def edit(df: DataFrame, which: Column, content: str) -> DataFrame:
    """New content for the rows, with its hash; their vector is no longer theirs."""
    out = df.withColumns({"content": F.when(which, content).otherwise(F.col("content"))})
    out = out.withColumn("hash", F.sha2("content", 256))
    return out.withColumn("embedding", F.when(~which, F.col("embedding"))) if "embedding" in df.columns else out


# --- episodes ----------------------------------------------------------------------------------------


def gap_clusters(df: DataFrame, by: Sequence[str], ts: str = "ts", gap_us: int = 900_000_000, key: str = "id") -> DataFrame:
    """``cluster``: runs of rows no more than the gap apart, numbered within ``by``."""
    w = Window.partitionBy(*by).orderBy(ts, key)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.when(us - F.lag(us).over(w) <= gap_us, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def episodes(clustered: DataFrame, by: Sequence[str], ts: str = "ts", key: str = "id", least: int = 3) -> DataFrame:
    """One node per cluster of at least ``least`` rows: span, count, header and id."""
    e = clustered.groupBy(*by, "cluster").agg(F.min(ts).alias("span_start"), F.max(ts).alias("span_end"), F.count("*").alias("n"), F.min(key).alias("first_id")).where(F.col("n") >= least)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    header = F.concat_ws(" ", F.lit("Episode"), *[F.col(b).cast("string") for b in by], fmt("span_start"), F.lit("-"), fmt("span_end"), F.col("n").cast("string"))
    return e.withColumn("header", header).withColumn("id", F.concat(F.lit("ep_"), F.substring(F.sha2("header", 256), 1, 16)))


def cluster_topics(clustered: DataFrame, by: Sequence[str], items: Column, k: int = 8) -> DataFrame:
    """The ``k`` most frequent items of each cluster, ties by name."""
    n = clustered.select(*by, "cluster", F.explode(items).alias("topic")).groupBy(*by, "cluster", "topic").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by, "cluster").orderBy(F.desc("n"), "topic")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cluster_entities(clustered: DataFrame, by: Sequence[str], text: str = "content", k: int = 10) -> DataFrame:
    """The ``k`` most frequent entities of each cluster: longer than two characters and no bare numbers."""
    names = F.filter(X.entities(F.col(text)), lambda x: (F.length(x) > 2) & ~x.rlike(r"^\d+$"))
    return cluster_topics(clustered, by, names, k).withColumnRenamed("topic", "entity")


def topics_or_words(clustered: DataFrame, by: Sequence[str], tags: str = "tags", text: str = "content", k: int = 8, k_words: int = 5) -> DataFrame:
    """The most frequent tags of each cluster; where it has none, its most frequent topic words (longer than three characters, no numbers)."""
    keys = [*by, "cluster"]
    tagged = cluster_topics(clustered, by, F.col(tags), k)
    bare = clustered.groupBy(*keys).agg(F.max(F.size(_list(tags))).alias("_n")).where("_n <= 0").select(*keys)
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9]+", " ")), " "), lambda w: (F.length(w) > 3) & ~w.rlike(r"^[0-9]+$") & ~w.isin(*sorted(STOP)))
    return tagged.unionByName(cluster_topics(clustered.join(bare, keys, "left_semi"), by, words, k_words))


def parent_edges(clustered: DataFrame, found: DataFrame, by: Sequence[str], key: str = "id") -> DataFrame:
    """Edges from each episode to its rows: (parent_id, child_id, weight)."""
    e = found.select(*by, "cluster", F.col("id").alias("parent_id"))
    return clustered.select(*by, "cluster", F.col(key).alias("child_id")).join(e, [*by, "cluster"]).select("parent_id", "child_id", F.lit(1.0).alias("weight"))


# --- back-fills --------------------------------------------------------------------------------------


def backfill(df: DataFrame, column: str, value: Column) -> DataFrame:
    """A column filled where it is null or blank; what is there stays."""
    has = F.trim(F.col(column)) != ""
    return df.withColumn(column, F.when(F.coalesce(has, F.lit(False)), F.col(column)).otherwise(value))


def backfill_app_ids(df: DataFrame, column: str = "app_id", text: str = "content") -> DataFrame:
    """The id that follows from the content, only where there is none."""
    return backfill(df, column, app_id(F.substring(F.coalesce(F.col(text), F.lit("")), 1, 4096)))


def backfill_cleaned(df: DataFrame, column: str = "cleaned", text: str = "content") -> DataFrame:
    return backfill(df, column, X.clean_content(F.col(text)))


def backfill_vectors(df: DataFrame, since: str, embed, dims: int, vec: str = "embedding", ts: str = "ts", text: str = "content") -> DataFrame:  # noqa: ANN001
    """Vectors of the rows since a time that have none; ``embed``: a function of a list of texts that gives a matrix, applied per Arrow batch."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<float>")
    def fill(texts):  # noqa: ANN001, ANN202
        m = np.asarray(embed(texts.fillna("").tolist()), np.float32).reshape(len(texts), dims)
        return pd.Series(list(m))

    due = F.col(vec).isNull() & (F.col(ts) >= F.lit(since).cast("timestamp"))
    return df.where(~F.coalesce(due, F.lit(False))).unionByName(df.where(due).withColumn(vec, fill(text)))


# --- tables --------------------------------------------------------------------------------------------


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Current rows with the changes put in by key; of several changes of one key the greatest row counts."""
    cols = current.columns
    last = changes.select(*cols).groupBy(key).agg(F.max(F.struct(*[c for c in cols if c != key])).alias("v")).select(key, *[f"v.{c}" for c in cols if c != key]).select(*cols)
    return current.join(last.select(key), key, "left_anti").unionByName(last)


def insert_only(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return current.unionByName(rows.dropDuplicates([key]).join(current.select(key), key, "left_anti").select(*current.columns))


def api_rows(rows: DataFrame) -> DataFrame:
    """Rows that come in from outside: their trust class is ``external`` whatever they say, and repeated ones stay."""
    return rows.withColumn("provenance", F.lit("external"))


def update_column(current: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    new = changes.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit")).dropDuplicates([key])
    return current.join(new, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit")


def delete_keys(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key).distinct(), key, "left_anti")


def replace_by_source(current: DataFrame, rows: DataFrame, source: str) -> DataFrame:
    """Full refresh: all rows of the sources that came in are replaced."""
    return delete_keys(current, rows, source).unionByName(rows.select(*current.columns))


def missing_after_write(written: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Keys that should be there and aren't."""
    return written.select(key).distinct().join(table.select(key), key, "left_anti")


def verified_write(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append rows, read them back, and fail if one is missing."""
    rows.write.mode("append").parquet(path)
    back = rows.sparkSession.read.parquet(path)
    if not missing_after_write(rows, back, key).isEmpty():
        raise RuntimeError(f"rows are missing after the write to {path}")
    return back


def unbound(rows: DataFrame, edges: DataFrame, key: str, child: str) -> DataFrame:
    """Rows that no edge leads to."""
    return rows.join(edges.select(F.col(child).alias(key)).distinct(), key, "left_anti")


# --- hygiene -------------------------------------------------------------------------------------------


def contaminated(df: DataFrame, markers: Sequence[str], text: str = "content", meta: str = "metadata", status: str = "status") -> DataFrame:
    """Rows with a marker in content or metadata; committed ones are never among them."""
    hit = X.any_of(*[F.coalesce(F.col(c).contains(m), F.lit(False)) for m in markers for c in (text, meta)])
    return df.where(hit & (F.coalesce(F.col(status), F.lit("")) != "committed"))


def to_verify(df: DataFrame, now: str, days: int = 30, importance: str = "importance", verified: str = "last_verified_at") -> DataFrame:
    return df.where((F.col(importance) > 7) & (F.col(verified).isNull() | (F.col(verified) < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))))


def stale(df: DataFrame, now: str, days: int = 90, importance: str = "importance", created: str = "created_at") -> DataFrame:
    return df.where((F.col(importance) < 3) & (F.col(created) < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")))


def evidence_score(facts: DataFrame, context: DataFrame) -> DataFrame:
    """(fact_id, n_evidence, score, verified): weights of the records that hold a long word of the fact, at most 1.

    Facts' words are joined to the distinct words of the records that hold them, a vocabulary far smaller than the records; each record
    is then met by equality on its words only."""
    w = facts.select("fact_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("fact"), r"\s+"), lambda x: F.length(x) > 4))).alias("w"))
    tokens = context.select("id", "weight", F.explode(F.array_distinct(F.split(F.lower("content"), r"\s+"))).alias("token")).where(F.length("token") > 4)
    # a word has no white space and so lies within one token: those of its stretches that are as long as some fact's word are looked up
    sizes = F.array(*[F.lit(r.n) for r in w.select(F.length("w").alias("n")).distinct().collect()]).cast("array<int>")  # at most as many as the longest word has characters
    spans = tokens.select("token").distinct().select("token", F.explode(F.filter(sizes, lambda n: n <= F.length("token"))).alias("n"))
    parts = spans.select("token", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - F.col("n") + 1), lambda i: F.substring("token", i, F.col("n")))).alias("w"))
    near = parts.join(w, "w").select("token", "fact_id").distinct()
    hit = tokens.join(near, "token").select("fact_id", "id", "weight").distinct()
    s = hit.groupBy("fact_id").agg(F.count("*").alias("n_evidence"), F.round(F.least(F.lit(1.0), F.sum("weight")), 6).alias("score"))
    return facts.select("fact_id").join(s, "fact_id", "left").select("fact_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("score", F.lit(0.0)).alias("score"), (F.coalesce("score", F.lit(0.0)) > 0.7).alias("verified"))


def accept(df: DataFrame, text: str = "content", key: str = "id") -> DataFrame:
    """The gate of new rows: no bare JSON or HTML, at least 20 characters when clean, one row per content (the least key)."""
    c = F.col(text)
    ok = df.where(~((X.json_like(c) | X.html_like(c)) & ~X.technical_signal(c))).withColumn("cleaned", X.clean_content(c)).where(F.length("cleaned") >= 20)
    h = ok.withColumn("content_hash", F.sha2("cleaned", 256))
    first = h.groupBy("content_hash").agg(F.min(key).alias(key))
    return h.join(first, ["content_hash", key], "left_semi")


def tag_soup(df: DataFrame, text: str = "content") -> DataFrame:
    return df.withColumn("tags", F.when(X.token_soup(F.col(text)), F.array_union(_list("tags"), F.array(F.lit("#corrupted")))).otherwise(_list("tags")))


def rotate(c: Column, keep: int = 25) -> Column:
    """The last lines of a context that grew too long."""
    lines = F.split(c, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - keep + 1), F.lit(keep)), "\n")


def live_state(df: DataFrame, now: str, ttl_s: int = 3600, key: str = "session_id", stamp: str = "last_active") -> DataFrame:
    """Latest state per key that hasn't expired."""
    last = df.groupBy(key).agg(F.max(F.struct(stamp, *[c for c in df.columns if c not in (key, stamp)])).alias("v")).select(key, "v.*")
    return last.where(F.unix_micros(F.col(stamp)) + ttl_s * 1_000_000 > F.unix_micros(F.lit(now).cast("timestamp")))


def cleared(df: DataFrame, keys: Sequence, key: str = "session_id") -> DataFrame:
    """State without the given keys'."""
    return df.where(~F.col(key).isin(list(keys)) | F.col(key).isNull())


def chat_rows(df: DataFrame) -> DataFrame:
    """Two rows of each exchange (chat_id, ts, user_text, ai_text): the user's, then the answer."""
    rows = F.array(F.struct(F.lit(0).alias("sequence"), F.lit("chat_user").alias("type"), F.col("user_text").alias("content")), F.struct(F.lit(1).alias("sequence"), F.lit("chat_ai").alias("type"), F.col("ai_text").alias("content")))
    return df.select("chat_id", "ts", F.explode(rows).alias("r")).select("chat_id", "ts", "r.*")
