"""Retrieval: inverted-index probe, anchors, tag walk, scoring, and the search strategies, batched over queries.

A batch of queries is a small frame of (query_id, part, attempt, term); its size is that of the request, never of the corpus.
One scan splits the texts, keeps the wanted words by a hash lookup and counts them within their row; only matches move, and
contents are fetched for the best rows alone. Nothing runs while a plan is built. Ties are broken by id, so that every
result is one and the same on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import query as Q

#: Terms of a batch up to which they are broadcast; those of a larger one are joined.
MOST_TERMS = 10_000
#: Rows that are broadcast, at most: results of a batch (queries times rows of each), or a request's keys.
MOST_ROWS = 100_000


@dataclass
class Request:
    query_id: int
    text: str
    buckets: Sequence[str] = ()
    tags: Sequence[str] = ()
    mode: str = "default"  # default, internal, external, all, quarantine
    attempts: list[list[str]] = field(default_factory=list)
    part: int = 0  # of a query that was split


def words(c: Column) -> Column:
    """Lower-case alphanumeric words of a text."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"[^a-zA-Z0-9]+", " ")), " "), lambda w: w != "")


TERMS = "query_id int, part int, attempt int, term string, n_terms int"


@dataclass
class Terms:
    """Term lists by query, part and attempt."""

    frame: DataFrame
    vocabulary: list[str]
    n: int

    def small(self, df: DataFrame) -> DataFrame:
        """A frame with a row per term, broadcast if the batch is within the bound."""
        return F.broadcast(df) if self.n <= MOST_TERMS else df


def term_frame(spark: SparkSession, terms: dict[tuple[int, ...], list[str]]) -> Terms:
    """``terms``: by (query, attempt) or (query, part, attempt)."""
    rows = [(k[0], k[1] if len(k) > 2 else 0, k[-1], t, len(set(ts))) for k, ts in terms.items() for t in dict.fromkeys(ts)]
    return Terms(spark.createDataFrame(rows, TERMS), sorted({r[3] for r in rows}), len(rows))


def postings(df: DataFrame, terms: Sequence[str] | None = None, key: str = "id", text: str = "content", carry: Sequence[str] = ()) -> DataFrame:
    """(term, id, tf): the inverted index, or the part of it for some terms. Words are counted within their row: nothing is shuffled."""
    w = words(F.col(text))
    if terms is not None:
        w = F.filter(F.split(F.lower(F.regexp_replace(F.col(text), r"[^a-zA-Z0-9]+", " ")), " "), lambda x: x.isin(list(terms)))
    counted = df.select(key, *carry, w.alias("_w"))  # the explode drops rows without words; a filter would split the texts once more
    return counted.select(key, *carry, "_w", F.explode(F.array_distinct("_w")).alias("term")).select("term", key, F.size(F.filter("_w", lambda x: x == F.col("term"))).cast("bigint").alias("tf"), *carry)


def fts(df: DataFrame, terms: Terms, key: str = "id", text: str = "content", carry: Sequence[str] = ()) -> DataFrame:
    """(query_id, part, attempt, id, fts, carried columns): documents that hold all terms of an attempt; score = sum of tf * ln(1 + N / df)."""
    within = terms.vocabulary if terms.n <= MOST_TERMS else None
    p = postings(df, within, key, text, carry)
    if within is None:
        p = p.join(terms.frame.select("term").distinct(), "term", "left_semi")
    weight = p.groupBy("term").agg(F.log(1 + df.agg(F.count("*")).scalar() / F.count("*")).alias("idf"))
    hits = p.join(terms.small(terms.frame), "term").join(terms.small(weight), "term")
    by = hits.groupBy("query_id", "part", "attempt", "n_terms", key, *carry).agg(F.count("*").alias("m"), F.round(F.sum(F.col("tf") * F.col("idf")), 6).alias("fts"))
    return by.where("m = n_terms").select("query_id", "part", "attempt", key, "fts", *carry)


def overlaps(c: str, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(F.coalesce(F.col(c), F.array().cast("array<string>")), F.array(*[F.lit(w) for w in wanted])) if wanted else F.lit(True)


def holds_all(c: str, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]).cast("array<string>"), F.col(c))) == 0


def trusted(mode: str) -> Column:
    """Rows a mode may see."""
    p = F.coalesce(F.col("provenance"), F.lit(""))
    return p == "quarantine" if mode == "quarantine" else F.lit(True) if mode == "all" else p != "quarantine"


def top(df: DataFrame, k: int, score: str = "score", by: Sequence[str] = ("query_id",), key: str = "id") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fetched(found: DataFrame, memory: DataFrame, n_rows: int) -> DataFrame:
    """The rows of ``memory`` that were found (``n_rows`` at most)."""
    return memory.join(F.broadcast(found) if n_rows <= MOST_ROWS else found, "id")


def filtered(hit: DataFrame, molecules: DataFrame | None, kind: str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """Hits that are fragments of a type and with a number between bounds (each where given); adds the fragments' columns."""
    if molecules is None:
        return hit
    keep = F.lit(True)
    if kind is not None:
        keep &= F.col("type") == kind
    if least is not None:
        keep &= F.col("numeric_value") >= least
    if most is not None:
        keep &= F.col("numeric_value") <= most
    return hit.join(molecules.where(keep), "id")


def anchors(memory: DataFrame, terms: Terms, k: int, keep: Column | None = None, molecules: DataFrame | None = None, kind: str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """The best ``k`` rows per query, filtered before the cut; score 70 * fts. ``molecules``: (id, type, numeric_value, numeric_unit) of fragments to filter by."""
    rows = memory.withColumn("_keep", F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True))
    hit = filtered(fts(rows, terms, carry=["_keep"]).where("_keep").drop("_keep"), molecules, kind, least, most)
    best = top(hit.withColumn("score", F.round(70 * F.col("fts"), 6)), k)
    return fetched(best, memory.drop(*([c for c in molecules.columns if c != "id"] if molecules is not None else [])), k * terms.n)


def tag_walk(memory: DataFrame, found: DataFrame, k: int, keep: Column | None = None, n_found: int = MOST_ROWS) -> DataFrame:
    """Rows that share a tag with a query's anchors and are no anchors themselves, at most ``k`` per query; score 30.

    The anchors' tags are few (k anchors of the request); the corpus is filtered by them in the scan, then deduplicated."""
    tags = found.select("query_id", F.explode("tags").alias("tag")).distinct()
    rows = (memory.where(keep) if keep is not None else memory).select("id", F.explode("tags").alias("tag"))
    near = rows.join(F.broadcast(tags) if n_found <= MOST_ROWS else tags, "tag").select("query_id", "id").distinct()
    near = near.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("score", F.lit(30.0))
    return fetched(top(near, k).drop("rank"), memory, n_found)


def boosted(df: DataFrame, mode: str = "default") -> DataFrame:
    """``score`` times the factors of provenance and type."""
    p = F.col("provenance")
    trust = {
        "internal": F.when(p == "internal", 3.0).otherwise(0.5),
        "external": F.when(p != "internal", 1.5).otherwise(1.0),
    }.get(mode, F.when(p == "internal", 2.0).otherwise(1.0))
    kind = F.when(F.col("type") == "code", 0.8).when(F.col("type") == "data", 0.6).when(F.col("type") == "log", 0.4).otherwise(1.0)
    return df.withColumn("score", F.round(F.col("score") * F.coalesce(trust, F.lit(1.0)) * kind, 6))


def first_wins(*branches: DataFrame, by: Sequence[str] = ("query_id", "id")) -> DataFrame:
    """Union of the branches; of equal keys the earliest branch's row stays."""
    out = None
    for i, b in enumerate(branches):
        b = b.withColumn("branch", F.lit(i))
        out = b if out is None else out.unionByName(b)
    w = Window.partitionBy(*by).orderBy("branch", F.desc("score"))
    return out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


SHOWN = ("query_id", "id", "content", "source", "ts", "buckets", "tags", "provenance", "type", "score")


def search(memory: DataFrame, requests: Sequence[Request], char_budget: int = 20_000, mode: str = "default", buckets: Sequence[str] = (), tags: Sequence[str] = (), today: date = date(2026, 2, 1), molecules: DataFrame | None = None, **filters) -> DataFrame:  # noqa: ANN003
    """Anchors of the first attempt that finds anything, with their tag walk, scored; one plan for all queries and attempts.

    A request's own buckets and tags hold for its rows only; ``filters`` are those of ``filtered``."""
    _, n_anchor, n_walk = Q.sizes(char_budget)
    terms = {(r.query_id, r.part, a): t for r in requests for a, t in enumerate(r.attempts or Q.strategies(r.text, today), 1)}
    base = trusted(mode) & overlaps("buckets", buckets) & overlaps("tags", tags)
    own = [F.when(overlaps("buckets", r.buckets) & overlaps("tags", r.tags), F.lit(f"{r.query_id}:{r.part}")) for r in requests]
    scoped = any(r.buckets or r.tags for r in requests)
    rows = memory.withColumns({"_keep": F.coalesce(base, F.lit(False)), "_may": F.array_compact(F.array(*own)) if scoped else F.lit(None).cast("array<string>")})
    frame = term_frame(memory.sparkSession, terms)
    asked = F.concat_ws(":", "query_id", "part")
    hit = fts(rows, frame, carry=["_keep", "_may"]).where("_keep")
    hit = hit.where(F.array_contains("_may", asked)) if scoped else hit
    hit = filtered(hit.drop("_keep", "_may"), molecules, **filters)
    # the first attempt is settled and the rest cut before any content is fetched
    first = hit.groupBy("query_id", "part").agg(F.min("attempt").alias("attempt"))
    best = hit.join(frame.small(first), ["query_id", "part", "attempt"])
    n = n_anchor * len(requests)
    found = top(best.withColumn("score", F.round(70 * F.col("fts"), 6)), n_anchor, by=("query_id", "part"))
    found = fetched(found.drop(*([c for c in molecules.columns if c != "id"] if molecules is not None else [])), memory, n)
    allowed = rows.where("_keep")
    walked = _walk(allowed, found, n_walk, asked if scoped else None, n)
    shown = ("query_id", "part", *SHOWN[1:])
    both = first_wins(found.select(*shown, "attempt"), walked.select(*shown, F.lit(None).cast("int").alias("attempt")), by=("query_id", "part", "id"))
    return boosted(both, mode)


def _walk(rows: DataFrame, found: DataFrame, k: int, asked: Column | None, n_found: int) -> DataFrame:
    """``tag_walk`` by query and part, within what each request may see."""
    tags = found.select("query_id", "part", F.explode("tags").alias("tag")).distinct()
    spread = rows.select("id", "_may", F.explode("tags").alias("tag"))
    near = spread.join(F.broadcast(tags) if n_found <= MOST_ROWS else tags, "tag")
    near = (near.where(F.array_contains("_may", asked)) if asked is not None else near).select("query_id", "part", "id").distinct()
    near = near.join(found.select("query_id", "part", "id"), ["query_id", "part", "id"], "left_anti").withColumn("score", F.lit(30.0))
    return fetched(top(near, k, by=("query_id", "part")).drop("rank"), rows.drop("_keep", "_may"), n_found)


#: Buckets that a hashtag of a query may name.
KNOWN_BUCKETS = ("notebook", "inbox", "codebase", "journal", "archive", "memories", "external")


def routed(r: Request, keywords: Sequence[str], today: date) -> Request:
    """A request whose hashtags became buckets and tags and whose terms were expanded by the keywords it holds. Without a bucket, its tags name buckets too."""
    text, named, tags = Q.scope(r.text.strip(), set(KNOWN_BUCKETS) | {w[1:].lower() for w in r.text.split() if w.startswith("#") and "inbox" in w.lower()})
    buckets, tags = [*r.buckets, *named], [*r.tags, *tags]
    more = [w for k in Q.expand(text, list(keywords)) for w in Q.fts(k).split()]
    ladder = [list(dict.fromkeys([*t, *more])) if not i else t for i, t in enumerate(r.attempts or Q.strategies(text, today))]
    return Request(r.query_id, text, buckets or list(tags), tags, r.mode, ladder, r.part)


def execute(
    memory: DataFrame, requests: Sequence[Request], char_budget: int = 20_000, mode: str = "default", keywords: Sequence[str] = (), engrams: DataFrame | None = None, molecules: DataFrame | None = None, today: date = date(2026, 2, 1), **filters,  # noqa: ANN003
) -> DataFrame:
    """The whole search before suppression and packing: hashtags routed, terms expanded, exact keys first, then anchors and their walk.

    Adds ``turn``, the order in which near copies give way: rows of exact keys go before all others."""
    sent = [routed(r, keywords, today) for r in requests]
    found = search(memory, sent, char_budget, mode, today=today, molecules=molecules, **filters).withColumn("turn", F.col("score"))
    if engrams is None:
        return found
    exact = [
        engram_lookup(engrams, memory, [r.text], r.tags, r.buckets).select(F.lit(r.query_id).alias("query_id"), F.lit(r.part).alias("part"), *SHOWN[1:], F.lit(None).cast("int").alias("attempt")).withColumn("turn", F.lit(1e18))
        for r in sent
    ]
    out = exact[0]
    for x in exact[1:]:
        out = out.unionByName(x)
    w = Window.partitionBy("query_id", "part", "id").orderBy(F.desc("turn"))
    return out.unionByName(found.drop("branch")).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def smart_search(memory: DataFrame, requests: Sequence[Request], char_budget: int = 20_000, enough: int = 10, today: date = date(2026, 2, 1)) -> DataFrame:
    """Whole queries first; where they find fewer than ``enough`` rows, their main entities are searched too and united by id.

    Adds ``budget``: the characters its results may fill, half as many again for a query that was split."""
    split = [Request(r.query_id, e, r.buckets, r.tags, r.mode, [[e]], i) for r in requests for i, e in enumerate(Q.entities(r.text), 1)]
    marked = search(memory, [*requests, *split], char_budget, today=today)
    n = F.count(F.when(F.col("part") == 0, 1)).over(Window.partitionBy("query_id"))
    used = marked.withColumn("n", n).where((F.col("part") == 0) | (F.col("n") < enough))
    w = Window.partitionBy("query_id", "id").orderBy("part", F.desc("score"))
    budget = F.when(F.col("n") < enough, F.lit(char_budget * 3 // 2)).otherwise(F.lit(char_budget))
    return used.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*SHOWN, budget.alias("budget"))


def molecule_search(memory: DataFrame, query_id: int, text: str, k: int = 20, today: date = date(2026, 2, 1)) -> DataFrame:
    """Each piece of a long query on its own, united by id (the earliest piece wins), by score."""
    parts = Q.molecules(text)
    frame = term_frame(memory.sparkSession, {(i, 1): Q.keywords(p, today) for i, p in enumerate(parts)})
    hit = anchors(memory, frame, k, trusted("default"))
    w = Window.partitionBy("id").orderBy("query_id")
    return hit.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(F.lit(query_id).alias("query_id"), F.col("query_id").alias("piece"), "id", "score")


# --- exact keys, substrings, rules ---------------------------------------------------------------


def engram_key(c: Column) -> Column:
    return F.md5(F.lower(F.trim(c)))


def engram_lookup(engrams: DataFrame, memory: DataFrame, keys: Sequence[str], tags: Sequence[str] = (), buckets: Sequence[str] = ()) -> DataFrame:
    """Rows named by exact keys that hold all the tags and buckets; score 200. ``engrams``: (key, value: JSON array of ids)."""
    wanted = memory.sparkSession.createDataFrame([(k,) for k in keys], "text string").select(engram_key(F.col("text")).alias("key")).distinct()
    ids = engrams.join(F.broadcast(wanted) if len(keys) <= MOST_ROWS else wanted, "key").select(F.explode(F.from_json("value", "array<bigint>")).alias("id")).distinct()
    return memory.join(ids, "id", "left_semi").where(holds_all("tags", tags) & holds_all("buckets", buckets)).withColumn("score", F.lit(200.0))


def substring_search(df: DataFrame, needle: str, k: int, content: str = "content", source: str = "source") -> DataFrame:
    """Rows whose content or source holds the text, whatever the case; content matches first."""
    low = needle.lower()
    c, s = F.lower(F.col(content)).contains(low), F.lower(F.col(source)).contains(low)
    place = F.when(F.coalesce(c, F.lit(False)), 0).when(F.coalesce(s, F.lit(False)), 1)
    return df.withColumn("place", place).where("place is not null").orderBy("place", "id").limit(k)


def cascade(df: DataFrame, needle: str, pattern: str, k: int) -> DataFrame:
    """Source name, then all words, then a pattern; of one source the first kind of match stays."""
    ws = F.array(*[F.lit(w) for w in Q.fts(needle).split()])
    kind = F.when(F.lower("source").contains(needle.lower()), 0).when(F.size(F.array_except(ws, words(F.col("content")))) == 0, 1).when(F.col("content").rlike(pattern), 2)
    w = Window.partitionBy("source").orderBy("kind", "id")
    return df.withColumn("kind", kind).where("kind is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").orderBy("kind", "source").limit(k).select("id", "source", "kind")


def recent_per_group(df: DataFrame, group: str, ts: str, k: int, key: str = "id") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(ts), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# Parts of source names that never may be shown.
BARRED_SOURCES = ("combined_text", "prompt-logs", "prompt_logs", "calibration_run", "dry-run", "dry_run", "tests/", "weaver")


def allowed(metadata: Column, content: Column) -> Column:
    """Whether a row may be shown. A status decides alone; else barred sources and marked contents are out, and what has an
    app id is in. What isn't known is denied."""
    field = lambda k: F.coalesce(F.get_json_object(metadata, f"$.{k}"), F.lit(""))
    source = F.lower(F.when(field("source") != "", field("source")).otherwise(field("path")))
    barred = source.rlike("|".join(b.replace("/", "\\/") for b in BARRED_SOURCES))
    marked = F.coalesce(content.contains("thinking_content") | F.lower(content).contains("[planner]"), F.lit(False)) | F.lower(F.coalesce(metadata, F.lit(""))).contains("thinking_content")
    return F.when(field("status") != "", field("status") == "committed").otherwise(~barred & ~marked & (field("app_id") != ""))


def reranked(df: DataFrame, score: str = "score", importance: str = "importance") -> DataFrame:
    return df.withColumn("score", F.round(F.col(score) + 0.2 * F.coalesce(F.col(importance), F.lit(0)) / 10, 6))


def hybrid(vector_hits: DataFrame, lexical_hits: DataFrame, recent: DataFrame, k: int) -> DataFrame:
    """Vector hits, then lexical ones, re-ranked by importance; queries without any get the recent rows."""
    found = reranked(first_wins(vector_hits, lexical_hits))
    spare = recent.join(found.select("query_id").distinct(), "query_id", "left_anti").withColumn("branch", F.lit(9))
    return top(found.unionByName(spare.select(*found.columns)), k)


# --- vectors --------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different length or without length."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def knn(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", block: int = 8192, vector_block: int = 2048) -> DataFrame:
    """(query_id, neighbour, score): the ``k`` nearest vectors of each query by cosine, exact.

    Queries and vectors are cut into blocks of about ``block`` and ``vector_block`` rows by a hash of the key. Each block of vectors meets each block of
    queries as one matrix product in a task of its own and gives the best ``k`` of each query: what is stated is a query set against
    all rows, in blocks, and nothing of either side reaches the driver but their numbers."""
    import numpy as np
    import pyarrow as pa

    n_q, n_v = (max(1, -(-df.count() // size)) for df, size in ((queries, block), (vectors, vector_block)))
    cut = lambda df, n, name: df.select(F.col(key), F.col(vec), F.pmod(F.xxhash64(F.col(key)), F.lit(n)).alias(name))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias(name)
    q = cut(queries, n_q, "qb").select("*", each(n_v, "vb"))
    v = cut(vectors, n_v, "vb").select("*", each(n_q, "qb"))

    def matrix(t: pa.Table, width: int) -> np.ndarray:
        m = np.array([x if x is not None and len(x) == width else [0.0] * width for x in t[vec].to_pylist()], float).reshape(t.num_rows, width)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def nearest(_key, a: pa.Table, b: pa.Table) -> pa.Table:
        ids, keys = a[key].to_numpy(), b[key].to_numpy()
        order = np.argsort(keys, kind="stable")  # of equal scores the least key goes first
        b, keys = b.take(pa.array(order)), keys[order]
        out = []
        for width in sorted({len(x) for x in a[vec].to_pylist() if x is not None} | {0}):
            mine = np.flatnonzero([(len(x) if x is not None else 0) == width for x in a[vec].to_pylist()])
            if not len(mine) or not len(keys):
                continue
            against = matrix(b, width).T
            for i in range(0, len(mine), 512):
                some = mine[i : i + 512]
                scores = matrix(a.take(pa.array(some)), width) @ against
                scores[ids[some][:, None] == keys[None, :]] = -2.0  # not itself
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                got = np.take_along_axis(scores, best, 1).ravel()
                out.append((np.repeat(ids[some], best.shape[1])[got > -2], keys[best].ravel()[got > -2], got[got > -2]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "neighbour": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    q, v = (df.repartition(n_q * n_v, "qb", "vb") for df in (q, v))  # a product each: sizes say nothing of the work
    pairs = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(nearest, "query_id bigint, neighbour bigint, score double")
    return top(pairs, k, key="neighbour")
