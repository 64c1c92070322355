"""Upkeep, statistics, sources and streams over the context tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.query import STOP
from ..operators import mirror
from ..operators import organize as O
from ..operators import retrieval as R
from ..operators import stats as S
from ..session import shared_dir, table
from ..sources import files
from ..streaming import ingest
from .base import DOCS, KEYWORDS, MEMORY, docs, joined, memory
from .text_queries import _CLEAN, _HTML, _JSON, _NAMED, _TECH
from .text_queries import SQL as TEXT_SQL

c = F.col
NOW = "2026-02-01 00:00:00"


# --- upkeep -------------------------------------------------------------------------------------------


def dream_rebucket(spark, d):
    m = memory(spark, d).withColumn("buckets", F.when(c("bucket").isNotNull(), F.array("bucket", F.lit("inbox"))))
    return O.dream(m).select("id", joined(F.array_sort("new_buckets")).alias("buckets"))


def discovery(spark, d):
    known = spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")
    return O.discover(docs(spark, d), known)


def master_keywords(spark, d):
    """The keyword table after a discovery over all texts."""
    known = spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")
    return O.grown_keywords(known, O.discover(docs(spark, d), known))


def seed_sample(spark, d):
    """A sampling operator: 100 rows by seed among those that hold a word, and 25 among all."""
    held = O.seed_sample(docs(spark, d), 7, 100, holding="pressure").select("id", F.lit("seed").alias("choice"))
    return held.unionByName(O.seed_sample(docs(spark, d), 11, 25).select("id", F.lit("explorer").alias("choice")))


def keyset_pages(spark, d):
    """The whole table in pages by key: page number and bounds of each."""
    t = table(spark, d, "entities").select("id")
    bounds = [(i, *p.agg(F.min("id"), F.max("id"), F.count("*")).first()) for i, p in enumerate(O.keyset_pages(t, "id", 500))]
    return spark.createDataFrame(bounds, "page int, first_id bigint, last_id bigint, n bigint")


def point_lookup(spark, d):
    return O.point_lookup(docs(spark, d), "id", [101, 260, 1006, 1488, 1821, 1866, -1]).select("id", F.md5("content").alias("digest"))


def app_ids_filled(spark, d):
    """How many rows kept their app id, and how many got the one of their content."""
    t = table(spark, d, "tmp_audit").select("eid", c("app_id").alias("given"), F.when(c("technical_signal"), c("app_id")).alias("app_id"), c("snippet").alias("content"))
    f = O.backfill_app_ids(t)
    return f.groupBy(F.col("app_id").eqNullSafe(F.col("given")).alias("kept")).agg(F.count("*").alias("n"), F.count(F.when(c("app_id").rlike("^[0-9a-f-]{36}$") | c("app_id").eqNullSafe(c("given")), 1)).alias("n_valid"))


def cleaned_filled(spark, d):
    t = docs(spark, d).withColumn("cleaned", F.when(c("lang") == "en", "was here"))
    return O.backfill_cleaned(t).select("id", "cleaned")


def vectors_filled(spark, d):
    """Rows with a vector before and after the back-fill of the recent ones; the model here counts letters."""
    t = docs(spark, d).select("id", "content", "ts", F.when(c("lang") == "en", F.array(F.lit(1.0), F.lit(0.0))).cast("array<float>").alias("embedding"))
    f = O.backfill_vectors(t, "2025-06-01 00:00:00", lambda xs: [[len(x), x.count("e")] for x in xs], 2)
    return f.select("id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


def sessions_cleared(spark, d):
    t = table(spark, d, "conversation_turns").select("session_id", "turn_num")
    return O.cleared(t.where("session_id is not null").groupBy("session_id").agg(F.max("turn_num").alias("turn_num")), ["s1", "s2"])


def quarantine_restore(spark, d):
    m = memory(spark, d)
    q = O.quarantine(m, c("bucket") == "code")
    r = O.restore(q, (c("provenance") == "quarantine") & (c("lang") == "en"))
    return r.select("id", "provenance", joined(F.array_sort("tags")).alias("tags"))


def quarantined_list(spark, d):
    return memory(spark, d).where("provenance = 'quarantine'").orderBy(F.desc("ts"), "id").limit(100).select("id")


def edited(spark, d):
    return O.edit(docs(spark, d), c("bucket") == "chat", "edited").select("id", "hash")


def upserted(spark, d):
    cur = docs(spark, d).select("id", "bucket", "lang")
    ch = docs(spark, d).where("lang = 'de'").select("id", F.lit("new").alias("bucket"), "lang").unionByName(spark.createDataFrame([(-1, "new", "xx"), (-1, "zew", "xx")], "id bigint, bucket string, lang string"))
    return O.upsert(cur, ch, "id")


def inserted(spark, d):
    cur = docs(spark, d).where("lang = 'de'").select("id", "bucket")
    return O.insert_only(cur, docs(spark, d).select("id", F.lit("later").alias("bucket")), "id")


def column_updated(spark, d):
    cur = docs(spark, d).select("id", "bucket")
    return O.update_column(cur, docs(spark, d).where("lang = 'fr'").select("id", F.lit("fr").alias("bucket")), "id", "bucket")


def source_replaced(spark, d):
    cur = docs(spark, d).select("id", c("bucket").alias("source"))
    new = spark.createDataFrame([(-5, "chat"), (-6, "nowhere")], "id bigint, source string")
    return O.replace_by_source(cur, new, "source")


def write_verified(spark, d):
    path = shared_dir(spark, "verified")
    back = O.verified_write(docs(spark, d).select("id", "bucket"), path, "id")
    return back.groupBy("bucket").agg(F.count("*").alias("n"))


def contamination(spark, d):
    t = docs(spark, d).withColumns({"metadata": F.to_json(F.struct("source")), "status": F.when(c("provenance") == "internal", "committed")})
    return O.contaminated(t, ["dossier", "hash_", "pump schedule"]).select("id")


def freshness(spark, d):
    t = docs(spark, d).withColumns({"importance": c("id") % 11, "last_verified_at": F.when(c("lang") == "en", c("ts"))})
    return O.to_verify(t, NOW).select("id", F.lit("verify").alias("what")).unionByName(O.stale(t.withColumn("created_at", c("ts")), NOW).select("id", F.lit("stale").alias("what")))


def evidence(spark, d):
    facts = spark.createDataFrame([(1, "the pressure reading was doubled"), (2, "zebra crossing outside"), (3, "la carpeta perdida"), (4, "no")], "fact_id int, fact string")
    k = memory(spark, d).withColumn("weight", X.evidence_weight(F.when(c("type") == "prose", "doc").otherwise(c("type")), F.coalesce("source", F.lit(""))))
    return O.evidence_score(facts, k)


def prov_score(spark, d):
    return docs(spark, d).select("id", X.provenance_score(c("bucket"), F.coalesce("source", F.lit("")), F.lit("doc")).alias("score"))


def ingest_gate(spark, d):
    return O.accept(docs(spark, d)).select("id")


def soup_tags(spark, d):
    t = table(spark, d, "token_soup_scan").where("original_excerpt is not null").select("eid", c("original_excerpt").alias("content"), F.array("field").alias("tags")).distinct()
    return O.tag_soup(t).where(F.array_contains("tags", "#corrupted")).select("eid").distinct()


def rotated_contexts(spark, d):
    return docs(spark, d).where(F.size(F.split("content", "\n")) > 25).select("id", O.rotate(c("content")).alias("tail"))


def live_sessions(spark, d):
    t = table(spark, d, "conversation_turns").where("session_id is not null").select("session_id", c("created_at").alias("last_active"), "turn_num")
    return O.live_state(t, "2025-12-31 00:00:00", 86_400 * 14).select("session_id", "turn_num")


def saved_chats(spark, d):
    t = table(spark, d, "weaver_review").select(c("review_id").alias("chat_id"), c("logged_at").alias("ts"), c("s_excerpt").alias("user_text"), c("orig_excerpt").alias("ai_text")).dropDuplicates(["chat_id"])
    return O.chat_rows(t).groupBy("type", "sequence").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def distill_worklist(spark, d):
    done = table(spark, d, "weaver_review").where("status = 'ok'").select("orig_eid")
    return O.unbound(table(spark, d, "tmp_audit").select("eid").distinct(), done, "eid", "orig_eid")


# --- episodes and windows -------------------------------------------------------------------------------


def gap_sessions(spark, d):
    g = O.gap_clusters(table(spark, d, "events"), ["user_id"], key="event_id")
    return g.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def session_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return ingest.sessions(e).select("user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n", "total")


def episodes(spark, d):
    g = O.gap_clusters(table(spark, d, "events"), ["user_id"], gap_us=86_400_000_000, key="event_id")
    return O.episodes(g, ["user_id"], key="event_id").select("user_id", "cluster", "n", "first_id", "id")


def episode_topics(spark, d):
    g = O.gap_clusters(table(spark, d, "events"), ["user_id"], gap_us=86_400_000_000, key="event_id")
    return O.cluster_topics(g, ["user_id"], F.array("event_type"), 2).select("user_id", "cluster", "topic", "n", "rank")


def _clusters(spark, d):
    return O.gap_clusters(memory(spark, d).where("bucket is not null and ts is not null"), ["bucket"], gap_us=3_600_000_000)


def episode_entities(spark, d):
    return O.cluster_entities(_clusters(spark, d), ["bucket"]).select("bucket", "cluster", "entity", "n", "rank")


def episode_words(spark, d):
    """Tags of the clusters, and topic words of those without any."""
    return O.topics_or_words(_clusters(spark, d), ["bucket"]).select("bucket", "cluster", "topic", "n", "rank")


def episode_parents(spark, d):
    g = O.gap_clusters(table(spark, d, "events"), ["user_id"], gap_us=86_400_000_000, key="event_id")
    return O.parent_edges(g, O.episodes(g, ["user_id"], key="event_id"), ["user_id"], "event_id").groupBy("parent_id").agg(F.count("*").alias("n"), F.min("child_id").alias("first_child"), F.sum("weight").alias("weight"))


def recent_per_group(spark, d):
    return R.recent_per_group(table(spark, d, "events"), "event_type", "ts", 10, "event_id").select("event_type", "event_id", "rank")


def paged(spark, d):
    return docs(spark, d).orderBy(F.desc("ts"), "id").offset(100).limit(50).select("id")


def mirror_paths(spark, d):
    return memory(spark, d).select("id", mirror.mirror_dir().alias("dir"))


def mirror_bundles(spark, d):
    m = memory(spark, d).withColumn("source", c("bucket"))
    return mirror.bundles(m, 20).groupBy("dir", "file").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def mirror_documents(spark, d):
    return mirror.documents(mirror.bundles(memory(spark, d))).select("dir", "file", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("digest"))


# --- statistics ---------------------------------------------------------------------------------------


def global_tags(spark, d):
    return S.global_tags(table(spark, d, "compound"), "atoms", 200)


def tag_counts(spark, d):
    return S.element_counts(table(spark, d, "compound"), "atoms")


def bucket_list(spark, d):
    return S.distinct_elements(memory(spark, d), "buckets").orderBy("element")


def backup_stats(spark, d):
    return S.table_counts({n: table(spark, d, n) for n in ("compound", "molecule", "documents", "entities", "atoms")})


def import_status(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.when(c("text").isNull(), "error").when(F.trim("text") == "", "skipped").otherwise("imported").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def turns_stats(spark, d):
    t = table(spark, d, "conversation_turns")
    return t.groupBy("speaker").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.sum("token_count").alias("tokens"))


def largest_sessions(spark, d):
    return table(spark, d, "conversation_turns").groupBy("session_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "session_id").limit(10)


def missing_links(spark, d):
    e = table(spark, d, "weaver_review").select("orig_eid").distinct()
    return O.unbound(table(spark, d, "tmp_audit").select("eid").distinct(), e, "eid", "orig_eid").agg(F.count("*").alias("n_missing"))


def score_histogram(spark, d):
    return S.score_histogram(table(spark, d, "weaver_review"), "score")


def score_thresholds(spark, d):
    return S.at_least(table(spark, d, "weaver_review"), "score", [0.5, 0.6, 0.65, 0.7, 0.75], "s_eid")


def weaver_summary(spark, d):
    return S.run_summary(table(spark, d, "weaver_review"), ["status"], ["score", "second_score", "delta_diff"])


def score_extremes(spark, d):
    return S.extremes(table(spark, d, "weaver_review").select("review_id", "score").distinct(), "score", "review_id").select("review_id", "score", "side")


def run_compare_median(spark, d):
    w = table(spark, d, "weaver_review")
    return w.groupBy("method").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.median("score"), 6).alias("median"), F.count("*").alias("n"))


def runs_side_by_side(spark, d):
    w = table(spark, d, "weaver_review").where("score is not null").select("review_id", "score", "method").distinct()
    return S.compare_runs(w.where("method = 'timestamp'"), w.where("method <> 'timestamp'"), "score", "review_id", 25)


def file_types(spark, d):
    t = docs(spark, d).where("source is not null").withColumns({"ext": X.extension(c("source")), "lines": F.size(F.split("content", "\n"))})
    return t.groupBy("ext").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))


def largest_files(spark, d):
    """The ten largest documents by lines, then length."""
    t = docs(spark, d).withColumns({"lines": F.size(F.split("content", "\n")), "chars": F.length("content")})
    return t.orderBy(F.desc("lines"), F.desc("chars"), "id").limit(10).select("id", "lines", "chars")


def consolidate_max(spark, d):
    e = table(spark, d, "events")
    return S.best_per_key(e, F.lower("event_type"), "value", ["event_id"])


def best_and_second(spark, d):
    return S.best_second(table(spark, d, "events"), "user_id", "value", "event_id")


def merged_tags(spark, d):
    from ..operators import dedup

    return dedup.merged_lists(memory(spark, d).where("bucket is not null"), "bucket", "tags").select("bucket", joined("tags").alias("tags"))


def json_props(spark, d):
    e = table(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.max("k").alias("most"))


def raw_sql_recursive(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("palimpsest_nation")
    return spark.sql(
        "with recursive chain(n, top) as (select n_nationkey, n_regionkey from palimpsest_nation where n_nationkey < 5 union all select n + 5, top from chain where n + 5 < 25) "
        "select top, count(*) as members, sum(n) as total from chain group by top"
    )


# --- sources and streams -----------------------------------------------------------------------------


def backup_roundtrip(spark, d):
    path = shared_dir(spark, "backup")
    t = {"documents": docs(spark, d).select("id", "content", "source", "bucket")}
    files.write_backup(t, path, {"documents": "id"})
    back = files.read_backup(spark, path, {"documents": t["documents"].schema})["documents"]
    return back.select("id", F.md5("content").alias("digest"), "bucket")


def combined_texts(spark, d):
    """Documents as combined texts, split again; a marker within a document ends it there, as the format has no escape."""
    one = docs(spark, d).select(F.concat(F.lit("--- START OF FILE: "), "id", F.lit(" ---\n"), "content", F.lit("\n--- END OF FILE: "), "id", F.lit(" ---")).alias("content"))
    return files.split_combined(one).select(c("path").cast("bigint").alias("id"), F.md5("content").alias("digest"))


def catalog_tables(spark, d):
    """Columns of every table, as the session's catalogue lists them."""
    names = ("atoms", "compound", "conversation_turns", "deleted_keys", "documents", "entities", "molecule", "repair_canary_run2", "tmp_audit", "token_soup_scan", "turn_entities", "weaver_review")
    for n in names:
        table(spark, d, n).createOrReplaceTempView(f"palimpsest_{n}")
    listed = [t.name for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith("palimpsest_") and t.name[11:] in names]
    rows = [(t[11:], x.name, i) for t in listed for i, x in enumerate(spark.catalog.listColumns(t))]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int")


def record_normaliser(spark, d):
    t = table(spark, d, "repair_canary_run2").select(c("repair_id").alias("uid"), c("s_created_at").alias("timestamp"), c("s_excerpt").alias("text")).distinct()
    return files.normalised_records(t).select("id", F.unix_micros("ts").alias("us"), F.length("content").alias("n_chars"))


def api_rows(spark, d):
    return O.api_rows(docs(spark, d)).groupBy("provenance").agg(F.count("*").alias("n"))


def file_search(spark, d):
    """The first 20 files by path whose name fits and whose text holds a word."""
    f = docs(spark, d).where("source is not null").select(c("source").alias("path"), "content")
    return files.search_files(f, "*.md", "pump", 20).groupBy("path").agg(F.count("*").alias("n"))


def squashed_sessions(spark, d):
    """Turns as session files of a folder each, put together in order of their numbers."""
    t = table(spark, d, "conversation_turns").where("session_id is not null and content is not null").groupBy("id").agg(F.min("session_id").alias("s"), F.min("content").alias("content"))
    f = t.select(F.concat(F.lit("h/"), (c("id") % 50).cast("string"), F.lit("/session_part_"), "id", F.lit(".md")).alias("path"), "content")
    return files.squashed(f).select("folder", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


def audit_appended(spark, d):
    """Audit rows appended twice as CSV and read again."""
    path = shared_dir(spark, "audit")
    w = table(spark, d, "weaver_review").where("review_id is not null").select("review_id", "method").distinct()
    for _ in range(2):
        files.append_audit(w, path)
    return spark.read.option("header", "true").schema("review_id bigint, method string").csv(path).groupBy("review_id").agg(F.count("*").alias("n"))


def redirects(spark, d):
    u = docs(spark, d).where("source is not null").select("id", "source", F.concat(F.lit("https://search.example/l/?uddg="), F.url_encode(F.concat(F.lit("https://a.example/"), "source"))).alias("url"))
    return u.select("id", files.redirect_target(c("url")).alias("target"))


def stream_ingest(spark, d):
    """Documents as files, taken in by the stream: one current row per path."""
    root = shared_dir(spark, "inbox")
    t = docs(spark, d).where(F.length("content") > 0).select(F.regexp_replace("content", r"[\r\n]", " ").alias("value"), c("bucket").alias("b")).where("b is not null")
    t.repartition("b").write.partitionBy("b").text(root)
    got = ingest.run_ingest(spark, root, shared_dir(spark, "ingested"), shared_dir(spark, "ingest_ckpt"))
    return got.select(F.regexp_extract("path", r"/b=([^/]*)/", 1).alias("bucket"), F.explode(F.split(F.regexp_replace("content", r"\n$", ""), "\n")).alias("line")).groupBy("bucket").agg(F.count("*").alias("lines"))


def stream_sessions(spark, d):
    """Closed sessions of the events, as the stream writes them."""
    path = f"{d}/events.parquet"
    raw = spark.read.parquet(path)
    src = shared_dir(spark, "events")
    raw.withColumn("ts", c("ts").cast("timestamp")).write.parquet(src)
    out = ingest.run_sessions(spark, src, spark.read.parquet(src).schema, shared_dir(spark, "sessions"), shared_dir(spark, "sessions_ckpt"))
    return out.select("user_id", F.unix_micros("first_ts").alias("first_us"), "n", "total")


QUERIES = {
    f.__name__: f
    for f in (
        dream_rebucket, discovery, master_keywords, seed_sample, keyset_pages, point_lookup, app_ids_filled, cleaned_filled, vectors_filled, sessions_cleared, quarantine_restore, quarantined_list, edited, upserted, inserted, column_updated, source_replaced, write_verified, contamination, freshness, evidence, prov_score, ingest_gate, soup_tags, rotated_contexts,
        live_sessions, saved_chats, distill_worklist, gap_sessions, session_windows, episodes, episode_topics, episode_entities, episode_words, episode_parents, recent_per_group, paged, mirror_paths, mirror_bundles, mirror_documents, global_tags, tag_counts, bucket_list, backup_stats,
        import_status, turns_stats, largest_sessions, missing_links, score_histogram, score_thresholds, weaver_summary, score_extremes, run_compare_median, runs_side_by_side, file_types, largest_files, consolidate_max, best_and_second, merged_tags,
        json_props, raw_sql_recursive, backup_roundtrip, combined_texts, catalog_tables, record_normaliser, api_rows, file_search, squashed_sessions, audit_appended, redirects, stream_ingest, stream_sessions,
    )
}

_GEN = "['core', 'misc', 'general', 'other', 'unknown']"
_TT = "[cast(year(t) as varchar), monthname(t), dayname(t), case when month(t) in (3,4,5) then 'Spring' when month(t) in (6,7,8) then 'Summer' when month(t) in (9,10,11) then 'Autumn' else 'Winter' end, 'Q' || quarter(t), case when hour(t) between 5 and 11 then 'Morning' when hour(t) between 12 and 16 then 'Afternoon' when hour(t) between 17 and 20 then 'Evening' else 'Night' end]"
_GAP = "g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) <= {gap} then 0 else 1 end as nw from events), k as (select *, sum(nw) over (partition by user_id order by ts, event_id rows unbounded preceding) as cluster from g)"
_SAFE = "substr(regexp_replace({}, '[^a-zA-Z0-9\\-_]', '_', 'g'), 1, 64)"
_DIR = (
    "'@' || " + _SAFE.format("case when list_has_any(tags, ['#manually_quarantined', '#auto_quarantined']) then 'quarantine' when coalesce(bucket, '') in ('', 'unknown') then 'general' else bucket end")
    + " || '/' || case when len(list_filter(tags, lambda t: t is distinct from coalesce(bucket, 'general') and t <> 'inbox')) > 0 then array_to_string(list_transform(list_sort(list_filter(list_distinct(tags), lambda t: t is distinct from coalesce(bucket, 'general') and t <> 'inbox')), lambda t: '#' || "
    + _SAFE.format("regexp_replace(t, '^#', '')") + "), '/') else '#_untagged' end"
)
_MS = [f"min({m}) as min_{m}, max({m}) as max_{m}, round(avg({m}), 6) as mean_{m}" for m in ("score", "second_score", "delta_diff")]
_ANY = "list_distinct(list_filter(string_split_regex(lower(fact), '\\s+'), lambda x: length(x) > 4))"
SQL = {
    "dream_rebucket": f"""with {MEMORY}, m as (select id, ts at time zone 'UTC' as t, case when bucket is not null then [bucket, 'inbox'] else [] end as b from memory),
 n as (select id, t, b, len(list_filter(b, lambda x: not list_contains({_GEN}, x))) = 0 or not coalesce(list_contains(b, cast(year(t) as varchar)), false) as todo,
 case when len(list_filter(list_distinct(b), lambda x: x not in ('core', 'pending') and not regexp_matches(x, '^[0-9]{{4}}$'))) < 2 then ['semantic_tag_placeholder'] else [] end as extra from m),
 j as (select id, t, b, todo, list_distinct(list_concat(b, extra, {_TT})) as x from n), s as (select *, list_filter(x, lambda v: v not in ('core', 'misc', 'general', 'other', 'unknown', 'pending', 'inbox')) as y from j)
 select id, array_to_string(list_sort(case when t is not null and todo then case when len(y) > 0 then y else x end else b end), '|') as buckets from s""",
    "quarantine_restore": f"with {MEMORY}, q as (select id, lang, case when bucket = 'code' then 'quarantine' else provenance end as p, case when bucket = 'code' then list_concat(tags, ['#manually_quarantined']) else tags end as tags from memory) select id, case when p = 'quarantine' and lang = 'en' then 'internal' else p end as provenance, array_to_string(list_sort(case when p = 'quarantine' and lang = 'en' then list_filter(tags, lambda t: t not in ('#manually_quarantined', '#auto_quarantined')) else tags end), '|') as tags from q",
    "quarantined_list": f"with {DOCS} select id from docs where provenance = 'quarantine' order by ts desc nulls last, id limit 100",
    "edited": f"with {DOCS} select id, sha256(case when bucket = 'chat' then 'edited' else content end) as hash from docs",
    "upserted": f"with {DOCS} select id, case when lang = 'de' then 'new' else bucket end as bucket, lang from docs union all select -1, 'zew', 'xx'",
    "inserted": f"with {DOCS} select id, case when lang = 'de' then bucket else 'later' end as bucket from docs",
    "column_updated": f"with {DOCS} select id, case when lang = 'fr' then 'fr' else bucket end as bucket from docs",
    "source_replaced": f"with {DOCS} select id, bucket as source from docs where bucket is distinct from 'chat' union all select -5, 'chat' union all select -6, 'nowhere'",
    "write_verified": f"with {DOCS} select bucket, count(*) as n from docs group by 1",
    "contamination": f"with {DOCS} select id from docs where provenance is distinct from 'internal' and (contains(content, 'dossier') or contains(content, 'hash_') or contains(content, 'pump schedule') or contains(coalesce(source, ''), 'dossier') or contains(coalesce(source, ''), 'hash_') or contains(coalesce(source, ''), 'pump schedule'))",
    "freshness": f"with {DOCS} select id, 'verify' as what from docs where id % 11 > 7 and (lang is distinct from 'en' or ts is null or ts < timestamptz '{NOW}+00' - interval 30 days) union all select id, 'stale' from docs where id % 11 < 3 and ts < timestamptz '{NOW}+00' - interval 90 days",
    "evidence": f"""with {MEMORY}, f(fact_id, fact) as (values (1, 'the pressure reading was doubled'), (2, 'zebra crossing outside'), (3, 'la carpeta perdida'), (4, 'no')),
 w as (select fact_id, unnest({_ANY}) as w from f), k as (select id, content, case when type = 'code' or regexp_matches(coalesce(source, ''), '\\.(py|log)$') then 1.0 when type = 'prose' or ends_with(coalesce(source, ''), '.md') then 0.8 else 0.5 end as weight from memory),
 h as (select distinct fact_id, id, weight from w join k on contains(lower(content), w)), s as (select fact_id, count(*) as n, least(1.0, sum(weight)) as score from h group by 1)
 select f.fact_id, coalesce(n, 0) as n_evidence, coalesce(score, 0) as score, coalesce(score, 0) > 0.7 as verified from f left join s using (fact_id)""",
    "prov_score": f"with {DOCS} select id, case when lower(bucket) = 'code' then 1.0 when lower(bucket) in ('log', 'logs') then 0.95 when lower(bucket) in ('doc', 'docs', 'documentation') then 0.8 when lower(bucket) in ('chat', 'conversation', 'message') then 0.4 when regexp_matches(coalesce(source, ''), '\\.(py|js)$') then 1.0 when ends_with(coalesce(source, ''), '.log') then 0.95 else 0.8 end as score from docs",
    "rotated_contexts": f"with {DOCS}, l as (select id, string_split(content, chr(10)) as x from docs) select id, array_to_string(x[-25:], chr(10)) as tail from l where len(x) > 25",
    "live_sessions": "with t as (select session_id, max({'a': created_at, 'b': turn_num}) as v from conversation_turns where session_id is not null group by 1) select session_id, v.b as turn_num from t where v.a > timestamptz '2025-12-31 00:00:00+00' - interval 14 days",
    "saved_chats": "with t as (select distinct review_id, s_excerpt, orig_excerpt from weaver_review) select 'chat_user' as type, 0 as sequence, count(*) as n, sum(length(s_excerpt)) as chars from t union all select 'chat_ai', 1, count(*), sum(length(orig_excerpt)) from t",
    "distill_worklist": "select distinct eid from tmp_audit where eid not in (select orig_eid from weaver_review where status = 'ok' and orig_eid is not null)",
    "gap_sessions": f"with {_GAP.format(gap=900_000_000)} select user_id, cluster, count(*) as n, round(sum(value), 4) as total from k group by 1, 2",
    "session_windows": f"with {_GAP.format(gap=900_000_000)} select user_id, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us, count(*) as n, round(sum(value), 4) as total from k group by user_id, cluster",
    "episodes": f"with {_GAP.format(gap=86_400_000_000)}, e as (select user_id, cluster, min(ts) as a, max(ts) as b, count(*) as n, min(event_id) as first_id from k group by 1, 2 having count(*) >= 3) select user_id, cluster, n, first_id, 'ep_' || substr(sha256('Episode ' || user_id || ' ' || strftime(a, '%Y-%m-%d %H:%M:%S') || ' - ' || strftime(b, '%Y-%m-%d %H:%M:%S') || ' ' || n), 1, 16) as id from e",
    "episode_topics": f"with {_GAP.format(gap=86_400_000_000)}, t as (select user_id, cluster, event_type as topic, count(*) as n from k group by 1, 2, 3), r as (select *, row_number() over (partition by user_id, cluster order by n desc, topic) as rank from t) select * from r where rank <= 2",
    "recent_per_group": "select event_type, event_id, rank from (select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id) as rank from events) where rank <= 10",
    "paged": f"with {DOCS} select id from docs order by ts desc nulls last, id limit 50 offset 100",
    "mirror_paths": f"with {MEMORY} select id, {_DIR} as dir from memory",
    "mirror_bundles": f"""with {MEMORY}, b as (select id, {_DIR} as dir, coalesce(bucket, '') as src, ts from memory), r as (select *, row_number() over (partition by dir, src order by ts nulls first, id) as rn, count(*) over (partition by dir, src) as n from b)
 select dir, lower({_SAFE.format("case when src in ('', 'unknown') then 'daily_archive' else src end")}) || '_' || substr(md5(case when src = '' then 'orphan' else src end), 1, 8) || case when n > 20 then '_part' || ((rn - 1) // 20 + 1) else '' end || '.md' as file, count(*) as n, sum(id) as ids from r group by 1, 2""",
    "global_tags": "select distinct x as element from (select unnest(atoms) as x from compound) where x is not null order by 1 limit 200",
    "tag_counts": "select x as element, count(*) as n from (select unnest(atoms) as x from compound) where x is not null group by 1",
    "bucket_list": "select distinct bucket as element from documents where bucket is not null and text is not null",
    "backup_stats": " union all ".join(f"select '{n}' as table_name, count(*) as n from {n}" for n in ("compound", "molecule", "documents", "entities", "atoms")),
    "import_status": "select case when text is null then 'error' when trim(text, ' ') = '' then 'skipped' else 'imported' end as status, count(*) as n from documents group by 1",
    "turns_stats": "select speaker, count(*) as n, sum(length(content)) as chars, sum(token_count) as tokens from conversation_turns group by 1",
    "largest_sessions": "select session_id, count(*) as n from conversation_turns group by 1 order by n desc, session_id nulls first limit 10",
    "missing_links": "select count(distinct eid) as n_missing from tmp_audit where eid not in (select orig_eid from weaver_review where orig_eid is not null)",
    "score_histogram": "select round(floor(score / 0.05 + 1e-9) * 0.05, 6) as bucket, count(*) as n from weaver_review where score is not null group by 1",
    "score_thresholds": "select t as threshold, count(*) filter (score >= t) as n, count(distinct case when score >= t then s_eid end) as n_keys from weaver_review, (values (0.5), (0.6), (0.65), (0.7), (0.75)) v(t) group by 1",
    "weaver_summary": f"select status, count(*) as n, count(*) filter (score < 0.38) as low, {', '.join(_MS)} from weaver_review group by 1",
    "score_extremes": "with d as (select distinct review_id, score from weaver_review where score is not null) (select review_id, score, 'top' as side from d order by score desc, review_id limit 5) union all (select review_id, score, 'bottom' from d order by score, review_id limit 5)",
    "run_compare_median": "select method, round(avg(score), 6) as mean, round(median(score), 6) as median, count(*) as n from weaver_review group by 1",
    "runs_side_by_side": "with d as (select distinct review_id, score, method from weaver_review where score is not null), a as (select row_number() over (order by score desc, review_id) as rank, review_id as review_id_a, score as score_a from d where method = 'timestamp'), b as (select row_number() over (order by score desc, review_id) as rank, review_id as review_id_b, score as score_b from d where method <> 'timestamp') select * from (select * from a where rank <= 25) full join (select * from b where rank <= 25) using (rank)",
    "file_types": f"with {DOCS} select lower(string_split(source, '.')[-1]) as ext, count(*) as n, sum(len(string_split(content, chr(10)))) as lines from docs where source is not null group by 1",
    "consolidate_max": "select key, v.value as value, v.event_id as event_id from (select lower(event_type) as key, max({'value': value, 'event_id': event_id}) as v from events group by 1)",
    "best_and_second": "with r as (select user_id, event_id as best, value as score, lead(value) over w as second, row_number() over w as rn from events window w as (partition by user_id order by value desc, event_id)) select user_id, best, score, second, round(score - coalesce(second, 0), 6) as delta from r where rn = 1",
    "merged_tags": f"with {MEMORY}, u as (select distinct bucket, unnest(tags) as t from memory where bucket is not null), g as (select bucket, array_to_string(list_sort(list(t)), '|') as tags from u group by 1) select b.bucket, coalesce(g.tags, '') as tags from (select distinct bucket from memory where bucket is not null) b left join g on g.bucket = b.bucket",
    "json_props": "select event_type, sum(cast(json_extract_string(props, '$.k') as int)) as k, max(cast(json_extract_string(props, '$.k') as int)) as most from events group by 1",
    "raw_sql_recursive": "with recursive chain(n, top) as (select n_nationkey, n_regionkey from nation where n_nationkey < 5 union all select n + 5, top from chain where n + 5 < 25) select top, count(*) as members, sum(n) as total from chain group by top",
    "backup_roundtrip": f"with {DOCS} select id, md5(content) as digest, bucket from docs",
    "combined_texts": f"with {DOCS} select id, md5(regexp_replace(content, '(?s)\n?--- END OF FILE.*$', '')) as digest from docs",
    "redirects": f"with {DOCS} select id, 'https://a.example/' || source as target from docs where source is not null",
    "stream_ingest": f"with {DOCS} select bucket, count(*) as lines from docs where length(content) > 0 and bucket is not null group by 1",
}
_NAMES = "select lower(name) as key, min(name) as name, count(*) as n from (select unnest(names) as name from e2) where length(name) > 2 and name not in ('The', 'And', 'For', 'This') group by 1"
_KNOWN = "[" + ", ".join(f"'{k.lower()}'" for k in KEYWORDS) + "]"
_HOURS = """c0 as (select *, ts_us - lag(ts_us) over (partition by bucket order by ts, id) as gap from {} where bucket is not null and ts is not null),
 clustered as (select *, sum(case when gap <= 3600000000 then 0 else 1 end) over (partition by bucket order by ts, id rows unbounded preceding) as cluster from c0)"""
_STOPS = "[" + ", ".join(f"'{w}'" for w in sorted(STOP)) + "]"
_MD = r"""coalesce(nullif(regexp_extract(content, '(?m)^#[ \t\n\x0b\f\r]+(.+)$', 1), ''), regexp_extract(trim(substr(content, 1, 50), ' '), '^([^\n]*)', 1))"""
SQL |= {
    "discovery": f"with {DOCS}, {_NAMED}, f as ({_NAMES}) select name, n from f where not list_contains({_KNOWN}, key)",
    "master_keywords": f"with {DOCS}, {_NAMED}, f as ({_NAMES}) select name as keyword from f where not list_contains({_KNOWN}, key) union all select unnest({KEYWORDS})",
    "seed_sample": f"with {DOCS} (select id, 'seed' as choice from docs where contains(lower(content), 'pressure') order by md5('7:' || id), id limit 100) union all (select id, 'explorer' from docs order by md5('11:' || id), id limit 25)",
    "keyset_pages": "with r as (select id, (row_number() over (order by id) - 1) // 500 as page from entities) select page, min(id) as first_id, max(id) as last_id, count(*) as n from r group by 1",
    "point_lookup": f"with {DOCS} select id, md5(content) as digest from docs where id in (101, 260, 1006, 1488, 1821, 1866, -1)",
    "app_ids_filled": "select technical_signal is true and trim(app_id, ' ') <> '' and app_id is not null as kept, count(*) as n, count(*) as n_valid from tmp_audit group by 1",
    "cleaned_filled": f"with {DOCS}, {_CLEAN} select id, case when d.lang = 'en' then 'was here' else cleaned end as cleaned from clean join docs d using (id)",
    "vectors_filled": f"with {DOCS} select id, case when lang = 'en' then 1.0 when ts >= timestamptz '2025-06-01 00:00:00+00' then cast(length(content) as double) end as x, case when lang = 'en' then 0.0 when ts >= timestamptz '2025-06-01 00:00:00+00' then cast(length(content) - length(replace(content, 'e', '')) as double) end as y from docs",
    "sessions_cleared": "select session_id, max(turn_num) as turn_num from conversation_turns where session_id not in ('s1', 's2') group by 1",
    "episode_entities": f"with {DOCS}, {_NAMED}, {_HOURS.format('docs')}, n as (select bucket, cluster, entity, count(*) as n from (select bucket, cluster, unnest(names) as entity from clustered join e2 using (id)) where length(entity) > 2 and not regexp_matches(entity, '^[0-9]+$') group by 1, 2, 3), r as (select *, row_number() over (partition by bucket, cluster order by n desc, entity) as rank from n) select * from r where rank <= 10",
    "episode_words": f"""with {MEMORY}, {_HOURS.format('memory')}, t as (select bucket, cluster, topic, count(*) as n from (select bucket, cluster, unnest(tags) as topic from clustered) group by 1, 2, 3),
 bare as (select bucket, cluster from clustered group by 1, 2 having max(len(tags)) = 0),
 w as (select bucket, cluster, topic, count(*) as n from (select bucket, cluster, unnest(string_split(lower(regexp_replace(content, '[^a-zA-Z0-9]+', ' ', 'g')), ' ')) as topic from clustered join bare using (bucket, cluster)) where length(topic) > 3 and not regexp_matches(topic, '^[0-9]+$') and not list_contains({_STOPS}, topic) group by 1, 2, 3),
 r as (select *, row_number() over (partition by bucket, cluster order by n desc, topic) as rank, 8 as k from t union all select *, row_number() over (partition by bucket, cluster order by n desc, topic), 5 from w) select bucket, cluster, topic, n, rank from r where rank <= k""",
    "episode_parents": f"select e.id as parent_id, e.n, e.first_id as first_child, cast(e.n as double) as weight from ({SQL['episodes']}) e",
    "largest_files": f"with {DOCS} select id, len(string_split(content, chr(10))) as lines, length(content) as chars from docs order by lines desc, chars desc, id limit 10",
    "ingest_gate": f"with {DOCS}, {_CLEAN}, k as (select id, cleaned, raw as snippet from clean), ok as (select id, cleaned from k where not (({_JSON} or {_HTML}) and not {_TECH}) and length(cleaned) >= 20) select min(id) as id from ok group by cleaned",
    "soup_tags": f"select distinct eid from ({TEXT_SQL['token_soup']}) where soup",
    "catalog_tables": "select table_name, column_name, ordinal_position - 1 as position from information_schema.columns where table_name in ('atoms', 'compound', 'conversation_turns', 'deleted_keys', 'documents', 'entities', 'molecule', 'repair_canary_run2', 'tmp_audit', 'token_soup_scan', 'turn_entities', 'weaver_review')",
    "mirror_documents": f"""with {MEMORY}, b as (select *, {_DIR} as dir, coalesce(source, '') as src from memory), r as (select *, row_number() over (partition by dir, src order by ts nulls first, id) as rn, count(*) over (partition by dir, src) as n from b),
 f as (select *, (rn - 1) // 100 + 1 as part, lower({_SAFE.format("case when src in ('', 'unknown') then 'daily_archive' else string_split(src, '/')[-1] end")}) || '_' || substr(md5(case when src = '' then 'orphan' else src end), 1, 8) || case when n > 100 then '_part' || ((rn - 1) // 100 + 1) else '' end || '.md' as file,
 '## [' || id || '] ' || {_MD} || chr(10) || '> **Provenance**: ' || coalesce(provenance, 'unknown') || ' | **Date**: ' || coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', 'unknown') || chr(10) || case when len(tags) > 0 then '> **Tags**: ' || array_to_string(tags, ', ') || chr(10) else '' end || chr(10) || content || chr(10) || chr(10) || '---' || chr(10) || chr(10) as block from r),
 g as (select dir, file, '# Source: ' || min(src) || chr(10) || case when max(n) > 100 then '> Part: ' || max(part) || chr(10) else '' end || chr(10) || '---' || chr(10) || chr(10) || string_agg(block, '' order by ts nulls first, id) as md from f group by 1, 2) select dir, file, length(md) as n_chars, md5(md) as digest from g""",
    "api_rows": f"with {DOCS} select 'external' as provenance, count(*) as n from docs",
    "file_search": f"with {DOCS}, k as (select source as path from docs where regexp_matches(source, '(^|/)[^/]*\\.md$') and contains(content, 'pump') order by source limit 20) select path, count(*) as n from k group by 1",
    "squashed_sessions": "with t as (select id, min(content) as content from conversation_turns where session_id is not null and content is not null group by 1), g as (select 'h/' || (id % 50) as folder, string_agg(content, chr(10) || chr(10) order by id) as x from t group by 1) select folder, length(x) as n_chars, md5(x) as digest from g",
    "audit_appended": "select review_id, 2 * count(distinct coalesce(method, '')) as n from weaver_review where review_id is not null group by 1",
}
