"""Retrieval, packing, relations and links over the context tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import query as Q
from ..functions import text as X
from ..operators import dedup, graph, links, packing
from ..operators import organize as O
from ..operators import retrieval as R
from ..session import table, write_shared
from .base import DOCS, KEYWORDS, MEMORY, docs, joined, memory

c = F.col
TODAY = date(2026, 2, 1)
NOW = "2026-02-01 00:00:00"
TERMS = {(1, 1): ["pressure", "queue"], (2, 1): ["glossary", "page"], (3, 1): ["snapshot"], (4, 1): ["nichts", "pressure"]}
REQUESTS = [R.Request(1, "What was the pressure of the queue?"), R.Request(2, "Please show the Glossary page"), R.Request(3, "snapshot zebra Messreihe")]


#: Requests with hashtags, and one whose whole text is an exact key.
ROUTED = [R.Request(1, "pressure #Pressure"), R.Request(2, "the Glossary page"), R.Request(3, "field"), R.Request(4, "queue of the pump", buckets=["chat", "notes"])]


def _frame(spark, terms=None):
    return R.term_frame(spark, terms or TERMS)


def fts_postings(spark, d):
    """Size of the inverted index per term of the batch."""
    p = R.postings(docs(spark, d), sorted({t for ts in TERMS.values() for t in ts}))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def fts_anchor_topk(spark, d):
    return R.top(R.fts(docs(spark, d), _frame(spark)), 20, "fts").select("query_id", "id", "fts", "rank")


def anchor_scored(spark, d):
    a = R.anchors(memory(spark, d), _frame(spark), 20, R.trusted("default"))
    return R.boosted(a).select("query_id", "id", "type", "provenance", "score")


def anchor_filtered(spark, d):
    keep = R.trusted("default") & R.overlaps("buckets", ["field", "notes", "code", "chat"])
    return R.anchors(memory(spark, d), _frame(spark), 10, keep).select("query_id", "id", "score")


def anchor_modes(spark, d):
    a = R.anchors(memory(spark, d), _frame(spark), 10, R.trusted("quarantine"))
    return R.boosted(a, "external").select("query_id", "id", "score")


def tag_walk(spark, d):
    m = memory(spark, d)
    a = R.anchors(m, _frame(spark), 5, R.trusted("default"))
    return R.tag_walk(m, a, 15, R.trusted("default")).select("query_id", "id", "score")


def walk_union(spark, d):
    m = memory(spark, d)
    a = R.anchors(m, _frame(spark), 5, R.trusted("default"))
    w = R.tag_walk(m, a, 15, R.trusted("default"))
    return R.first_wins(a.select("query_id", "id", "score"), w.select("query_id", "id", "score")).select("query_id", "id", "score", "branch")


def tag_overlap_filter(spark, d):
    return memory(spark, d).where(R.overlaps("tags", ["Pressure", "pump"])).select("id")


def tag_subset_filter(spark, d):
    return memory(spark, d).where(R.holds_all("tags", ["Pressure", "queue"])).select("id")


def executed_search(spark, d):
    """Near copies give way within the results, and leave their tags to the row that stays."""
    found = R.search(memory(spark, d), REQUESTS, 8000, today=TODAY)
    fp = found.withColumn("simhash", K.simhash("content"))
    return dedup.suppress(fp).select("query_id", "id", F.round("score", 4).alias("score"), F.array_join(F.array_sort("tags"), "|").alias("tags"))


def searched_scored(spark, d):
    """The same results before near copies give way."""
    return R.search(memory(spark, d), REQUESTS, 8000, today=TODAY).select("query_id", "id", F.coalesce("attempt", F.lit(0)).alias("attempt"), F.round("score", 4).alias("score"))


def _routed(spark, d):
    m = memory(spark, d)
    e = m.groupBy(R.engram_key(F.col("bucket")).alias("key")).agg(F.to_json(F.array_sort(F.collect_list("id"))).alias("value"))
    return R.execute(m, ROUTED, 8000, keywords=KEYWORDS, engrams=e, today=TODAY)


def routed_search(spark, d):
    """Hashtags as buckets and tags, keywords of the query added, exact keys before all else."""
    return _routed(spark, d).select("query_id", "id", F.round("score", 4).alias("score"))


def whole_search(spark, d):
    """The pipeline to its end: near copies give way, the rest is packed under the budget."""
    kept = dedup.suppress(_routed(spark, d).withColumn("simhash", K.simhash("content")), order="turn")
    p = packing.pack(packing.mixed_score(kept, "pressure", NOW), 2000)
    return p.select("query_id", "id", F.round("mixed", 4).alias("mixed"), F.length("packed").alias("n_chars"), "position")


def anchor_by_number(spark, d):
    """Fragments that hold the terms, of a type and with a number between bounds, filtered before the cut."""
    m = table(spark, d, "molecule").where("content is not null").groupBy("id").agg(F.max(F.struct("content", "type", "numeric_value", "numeric_unit")).alias("v")).select("id", "v.*")
    frame = R.term_frame(spark, {(1, 1): ["pressure"], (2, 1): ["queue"], (3, 1): ["valve"]})
    a = R.anchors(m.select("id", "content"), frame, 15, molecules=m.drop("content"), kind="data", least=10.0, most=5000.0)
    return a.select("query_id", "id", "score", "type", F.round("numeric_value", 4).alias("numeric_value"))


def smart_split_union(spark, d):
    return R.smart_search(memory(spark, d), REQUESTS, 8000, today=TODAY).select("query_id", "id", F.round("score", 4).alias("score"), "budget")


def molecule_pieces(spark, d):
    return R.molecule_search(memory(spark, d), 7, "the pressure queue, the glossary page; a snapshot of the pump", 10, TODAY).select("query_id", "piece", "id", "score")


def iterative_attempts(spark, d):
    """The attempt that finds something first, per query."""
    r = [R.Request(1, "pressure zebra", attempts=[["pressure", "zebra"], ["pressure"]]), R.Request(2, "zebra", attempts=[["zebra"], ["zebras"]]), R.Request(3, "queue", attempts=[["queue"], ["pressure"]])]
    return R.search(memory(spark, d), r, 8000, today=TODAY).where("attempt is not null").groupBy("query_id", "attempt").agg(F.count("*").alias("n"))


def engram_lookup(spark, d):
    m = memory(spark, d)
    e = m.groupBy(R.engram_key(F.concat(F.lit(" "), F.upper("bucket"))).alias("key")).agg(F.to_json(F.array_sort(F.collect_list("id"))).alias("value"))
    return R.engram_lookup(e, m, ["field", "Chat "], tags=["Pressure"]).select("id", "score")


def basic_substring(spark, d):
    return R.substring_search(docs(spark, d), "Pump", 50).select("id", "place")


def file_cascade(spark, d):
    return R.cascade(docs(spark, d).where("source is not null"), "pump schedule", r"retry\s+queue", 40)


def near_dup_suppressed(spark, d):
    """Documents that no kept earlier one nearly equals, over the whole table."""
    return dedup.suppress_all(write_shared(docs(spark, d).select("id", K.simhash("content").alias("simhash")), "simhashes"))


def pack_budget(spark, d):
    a = R.anchors(memory(spark, d), _frame(spark), 40, R.trusted("default"))
    p = packing.pack(packing.mixed_score(a, "pressure", NOW), 1500)
    return p.select("query_id", "id", "mixed", F.length("packed").alias("n_chars"), "position")


def pack_recent(spark, d):
    a = R.anchors(memory(spark, d), _frame(spark), 40, R.trusted("default"))
    return packing.prompt(packing.pack(packing.mixed_score(a, "latest pressure", NOW), 1200))


def recency_mix(spark, d):
    m = docs(spark, d).withColumn("score", F.lit(1.0))
    return packing.mixed_score(m, "plain", NOW).select("id", "mixed")


def elastic_windows(spark, d):
    return packing.elastic_windows(docs(spark, d), ["retry queue", "Pump Schedule"], 20_000)


def bright_edges(spark, d):
    return graph.bright_edges(_bright(spark, d), 50)


def _bright(spark, d):
    return memory(spark, d).where("id is not null").withColumns({"score": F.size("tags").cast("double"), "source": F.col("bucket"), "sequence": (F.col("id") % 40).cast("int")})


def structured_graph_nodes(spark, d):
    n = _bright(spark, d).orderBy(F.desc("score"), "id").limit(50)
    return graph.structured_graph(n, graph.bright_edges(n, 50)).select("id", F.length("content").alias("n_chars"), F.coalesce(F.size("edges"), F.lit(0)).alias("n_edges"))


def unbound_antijoin(spark, d):
    """Entities that no turn is linked to."""
    return O.unbound(table(spark, d, "entities").select("id").distinct(), table(spark, d, "turn_entities"), "id", "entity_id")


def content_dedup(spark, d):
    return dedup.content_duplicates(docs(spark, d), "id", "content")


def hash_change_detection(spark, d):
    """Of the internal files registered earlier (the French ones have changed since), and the others, those to read again."""
    m = docs(spark, d).select(c("id").cast("string").alias("path"), F.sha2("content", 256).alias("hash"), "provenance", "lang")
    from ..sources.files import changed

    reg = m.where("provenance = 'internal'").select("path", F.when(c("lang") == "fr", "old").otherwise(c("hash")).alias("hash"), F.lit(1).alias("last_ingest"))
    return changed(m, reg).select("path")


def session_next_edges(spark, d):
    t = table(spark, d, "conversation_turns").select("session_id", "turn_num", "id").distinct()
    w = t.groupBy("session_id", "turn_num").agg(F.min("id").alias("id"))
    return graph.next_edges(w, "session_id", "turn_num", "id")


def moment_entity_union(spark, d):
    items = table(spark, d, "conversation_turns").groupBy("id").agg(F.min("content").alias("content"))
    mentions = table(spark, d, "turn_entities").select(c("turn_id").alias("item_id"), "entity_id")
    return graph.entity_search(items, mentions, table(spark, d, "entities"), "garden", 200)


def vector_knn(spark, d):
    v = table(spark, d, "embeddings")
    return R.knn(v.where("vec_id % 50 = 0"), v, 5).select("query_id", "neighbour", F.round("score", 4).alias("score"), "rank")


def hybrid_rerank(spark, d):
    v = table(spark, d, "embeddings")
    base = docs(spark, d).select("id", (c("id") % 11).alias("importance"), "bucket", "ts")
    near = R.knn(v.where("vec_id % 50 = 0"), v, 8).select("query_id", c("neighbour").alias("id"), "score").join(base.drop("bucket", "ts"), "id", "left").select("query_id", "id", "score", "importance")
    lex = R.anchors(memory(spark, d), _frame(spark), 8).withColumn("importance", c("id") % 11).select(c("query_id").cast("bigint").alias("query_id"), "id", "score", "importance")
    recent = R.recent_per_group(base, "bucket", "ts", 3).withColumns({"query_id": F.lit(99).cast("bigint"), "score": F.lit(0.0)}).select("query_id", "id", "score", "importance")
    return R.hybrid(near, lex, recent, 10).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


def visible_memories(spark, d):
    meta = F.to_json(F.struct(F.when(c("provenance") == "internal", "committed").when(c("provenance") == "quarantine", "draft").alias("status"), c("source").alias("path"), F.when(c("lang").isNotNull(), c("id").cast("string")).alias("app_id")))
    return docs(spark, d).withColumn("metadata", meta).where(R.allowed(c("metadata"), c("content"))).select("id")


def asof_link(spark, d):
    e = table(spark, d, "events").select(c("event_id").alias("id"), "ts", "event_type")
    return links.asof_links(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'"), 600)


def jaccard_link(spark, d):
    m = docs(spark, d)
    s = m.where("provenance = 'external'").select("id", "content", F.ceil(F.length("content") / 4).alias("n_tokens"))
    return links.jaccard_links(s, m.where("provenance <> 'external'").select("id", "content"))


def weave_links(spark, d):
    """A run over both halves of the summaries."""
    v = table(spark, d, "embeddings").select(c("vec_id").alias("id"), "embedding", "label", (c("vec_id") % 7).alias("app"), F.timestamp_seconds(F.lit(1735689600) + c("vec_id") * 3600).alias("ts"))
    runs = [links.weave(v.where("label < 5"), v.where("label >= 5"), "run", batch=i, batches=2) for i in range(2)]
    return runs[0].unionByName(runs[1]).select("s_id", "o_id", "method", "score", "status")


def legacy_search(spark, d):
    """The older search: k from the budget, one bucket."""
    t = R.term_frame(spark, {(1, 1): ["pressure"], (2, 1): ["queue"]})
    return R.anchors(memory(spark, d), t, Q.legacy_k(20_000), c("bucket").isin("field", "notes")).select("query_id", "id", "fts")


def embed_link_delta(spark, d):
    v = table(spark, d, "embeddings").select(c("vec_id").alias("id"), "embedding", "label", (c("vec_id") % 7).alias("app"), F.timestamp_seconds(F.lit(1735689600) + c("vec_id") * 3600).alias("ts"))
    return links.vector_links(v.where("label < 5"), v.where("label >= 5"), 24, 0.3, 0.02)


def declared_link(spark, d):
    w = table(spark, d, "weaver_review").select("review_id", "orig_app_id", "orig_eid", "method").distinct()
    s = w.select(c("review_id").alias("id"), F.to_json(F.struct(F.when(c("method") == "timestamp", c("orig_app_id")).alias("original_app_id"), c("orig_eid").alias("original_id"))).alias("metadata"))
    return _declared(s, spark, d)


def _declared(s, spark, d):
    o = table(spark, d, "tmp_audit").select(F.element_at(F.split("eid", ":"), -1).try_cast("bigint").alias("id"), "app_id").where("id is not null").distinct()
    t = s.withColumn("metadata", F.regexp_replace("metadata", r'"original_id":"[^"]*:(\d+)"', '"original_id":"$1"'))
    return links.declared_links(t, o)


def run_rollback(spark, d):
    w = table(spark, d, "weaver_review")
    pairs = w.select("s_eid", "orig_eid").where("s_eid is not null and orig_eid is not null").distinct()
    return links.rollback(pairs, w.where("status <> 'ok'"), "s_eid", "orig_eid")


def committed_edges(spark, d):
    w = table(spark, d, "weaver_review").where("status = 'ok'").select("review_id", "s_eid", "orig_eid").distinct()
    r = table(spark, d, "repair_canary_run2").select("s_eid", "orig_eid")
    return links.verify_edges(w, r, "orig_eid").select("review_id", "found").distinct()


def entity_upsert(spark, d):
    e = docs(spark, d).select("id", F.explode(X.hashtags(c("content"))).alias("name")).withColumn("type", F.lit("tag"))
    nodes, edges = links.upsert_entities(e)
    n = edges.groupBy("key").agg(F.count("*").alias("n"))
    return nodes.join(n, "key").select("key", "name", "n")


def date_interpolate(spark, d):
    e = table(spark, d, "events").withColumn("known", F.when(c("event_type") == "purchase", c("ts")))
    return links.interpolate_dates(e.select("user_id", "event_id", "known"), "user_id", "event_id", "known", "2024-01-01 00:00:00", "2024-01-31 00:00:00").select("event_id", "filled_us", "is_estimated")


QUERIES = {
    f.__name__: f
    for f in (
        fts_postings, fts_anchor_topk, anchor_scored, anchor_filtered, anchor_modes, tag_walk, walk_union, tag_overlap_filter, tag_subset_filter, executed_search, searched_scored, routed_search, whole_search, anchor_by_number, smart_split_union, molecule_pieces, iterative_attempts, engram_lookup,
        basic_substring, file_cascade, near_dup_suppressed, pack_budget, pack_recent, recency_mix, elastic_windows, bright_edges, structured_graph_nodes, unbound_antijoin, content_dedup, hash_change_detection, session_next_edges,
        moment_entity_union, vector_knn, hybrid_rerank, visible_memories, asof_link, jaccard_link, weave_links, legacy_search, embed_link_delta, declared_link, run_rollback, committed_edges, entity_upsert, date_interpolate,
    )
}

_T = ", ".join(f"({q}, '{t}', {len(ts)})" for (q, _), ts in TERMS.items() for t in ts)
_FTS = rf"""
terms(query_id, term, n_terms) as (values {_T}),
word as (select id, unnest(string_split(lower(regexp_replace(content, '[^a-zA-Z0-9]+', ' ', 'g')), ' ')) as term from docs),
post as (select term, id, count(*) as tf from word where term in (select term from terms) group by 1, 2),
idf as (select term, ln(1 + (select count(*) from docs) / cast(count(*) as double)) as w from post group by 1),
fts as (select query_id, id, round(sum(tf * w), 6) as fts from post join terms using (term) join idf using (term) group by query_id, id, n_terms having count(*) = n_terms)
"""


def _anchors(k: int, keep: str) -> str:
    return f"anchors as (select * from (select f.query_id, m.*, round(70 * fts, 6) as score, row_number() over (partition by query_id order by round(70 * fts, 6) desc, m.id) as rank from fts f join memory m on m.id = f.id where {keep}) where rank <= {k})"


_OPEN = "coalesce(provenance, '') <> 'quarantine'"
_KIND = "(case type when 'code' then 0.8 when 'data' then 0.6 when 'log' then 0.4 else 1.0 end)"
_WALK = f"""
seed as (select distinct query_id, unnest(tags) as tag from anchors),
near as (select distinct s.query_id, m.id from (select id, unnest(tags) as tag from memory where {_OPEN}) m join seed s using (tag)),
walk as (select * from (select query_id, id, 30.0 as score, row_number() over (partition by query_id order by id) as rank from near where not exists (select 1 from anchors a where a.query_id = near.query_id and a.id = near.id)) where rank <= 15)
"""
_BRIGHT = """
n as (select *, cast(len(tags) as double) as score, bucket as src, cast(id % 40 as int) as seq from memory order by score desc, id limit 50),
e as (select a.id as from_id, b.id as to_id, case when a.src = b.src and abs(a.seq - b.seq) = 1 then 'next_chunk' when a.src = b.src then 'same_source' else 'related' end as relation,
 2 * len(list_intersect(a.buckets, b.buckets)) + len(list_intersect(a.tags, b.tags)) + case when a.src = b.src then 5 + case when abs(a.seq - b.seq) = 1 then 10 when abs(a.seq - b.seq) < 5 then 3 else 0 end else 0 end as strength
 from n a join n b on a.id <> b.id),
r as (select *, row_number() over (partition by from_id order by strength desc, to_id) as rank from e where strength > 0)
"""
_PACK = rf"""
mix as (select *, round(0.7 * score + 0.3 * greatest(0, 1 - greatest(0, (epoch_us(timestamptz '{NOW}+00') - ts_us) / 1e6) / 2592000), 6) as mixed, length(content) as n from anchors),
tot as (select *, sum(n) over (partition by query_id order by mixed desc, id rows unbounded preceding) as total, row_number() over (partition by query_id order by mixed desc, id) as rk from mix),
ov as (select *, min(case when total > {{budget}} then rk end) over (partition by query_id) as over_at, {{budget}} - (total - n) as room from tot),
cut as (select *, substr(content, 1, cast(greatest(0, room) as bigint)) as head from ov),
fin as (select *, length(head) - length(regexp_extract(head, '[^.!?\n]*$')) as stop from cut),
pk as (select *, case when over_at is null or rk < over_at then n when rk = over_at and room > 200 then case when stop - 1 > room * 0.5 then stop + 12 else length(head) + 3 end end as n_chars from fin)
"""
SQL = {
    "fts_postings": f"with {DOCS}, {_FTS} select term, count(*) as df, sum(tf) as tf from post group by 1",
    "fts_anchor_topk": f"with {DOCS}, {_FTS} select * from (select query_id, id, fts, row_number() over (partition by query_id order by fts desc, id) as rank from fts) where rank <= 20",
    "anchor_scored": f"with {MEMORY}, {_FTS}, {_anchors(20, _OPEN)} select query_id, id, type, provenance, round(score * (case when provenance = 'internal' then 2.0 else 1.0 end) * {_KIND}, 6) as score from anchors",
    "anchor_filtered": f"with {MEMORY}, {_FTS}, {_anchors(10, _OPEN + ' and list_has_any(buckets, ' + repr(['field', 'notes', 'code', 'chat']) + ')')} select query_id, id, score from anchors",
    "anchor_modes": f"""with {MEMORY}, {_FTS}, {_anchors(10, "provenance = 'quarantine'")} select query_id, id, round(score * 1.5 * {_KIND}, 6) as score from anchors""",
    "tag_walk": f"with {MEMORY}, {_FTS}, {_anchors(5, _OPEN)}, {_WALK} select query_id, id, score from walk",
    "walk_union": f"with {MEMORY}, {_FTS}, {_anchors(5, _OPEN)}, {_WALK} select query_id, id, score, 0 as branch from anchors union all select query_id, id, score, 1 from walk",
    "tag_overlap_filter": f"with {MEMORY} select id from memory where list_has_any(tags, ['Pressure', 'pump'])",
    "tag_subset_filter": f"with {MEMORY} select id from memory where list_has_all(tags, ['Pressure', 'queue'])",
    "iterative_attempts": f"""with {MEMORY}, t(query_id, attempt, word) as (values (1, 1, 'zebra pressure'), (1, 2, 'pressure'), (3, 1, 'queue')),
 w as (select id, provenance, list_distinct(string_split(lower(regexp_replace(content, '[^a-zA-Z0-9]+', ' ', 'g')), ' ')) as ws from memory where {_OPEN}),
 hit as (select query_id, attempt, id from t join w on list_has_all(ws, string_split(word, ' '))), first as (select *, min(attempt) over (partition by query_id) as a from hit),
 k as (select query_id, attempt, row_number() over (partition by query_id order by id) as r from first where attempt = a) select query_id, attempt, count(*) as n from k where r <= {Q.sizes(8000)[1]} group by 1, 2""",
    "engram_lookup": f"with {MEMORY} select id, 200.0 as score from memory where bucket in ('field', 'chat') and list_contains(tags, 'Pressure')",
    "basic_substring": f"with {DOCS}, p as (select id, case when contains(lower(content), 'pump') then 0 when contains(lower(source), 'pump') then 1 end as place from docs) select id, place from p where place is not null order by place, id limit 50",
    "file_cascade": rf"with {DOCS}, k as (select id, source, case when contains(lower(source), 'pump schedule') then 0 when list_has_all(string_split(lower(regexp_replace(content, '[^a-zA-Z0-9]+', ' ', 'g')), ' '), ['pump', 'schedule']) then 1 when regexp_matches(content, 'retry\s+queue') then 2 end as kind from docs where source is not null), f as (select *, row_number() over (partition by source order by kind, id) as rn from k where kind is not null) select id, source, kind from f where rn = 1 order by kind, source limit 40",
    "pack_budget": f"with {MEMORY}, {_FTS}, {_anchors(40, _OPEN)}, {_PACK.format(budget=int(1500 * 0.95) * 4)} select query_id, id, mixed, n_chars, row_number() over (partition by query_id order by ts_us, id) as position from pk where n_chars is not null",
    "recency_mix": f"with {DOCS} select id, round(0.7 * 1.0 + 0.3 * coalesce(greatest(0, 1 - greatest(0, (epoch_us(timestamptz '{NOW}+00') - ts_us) / 1e6) / 2592000), 0), 6) as mixed from docs",
    "bright_edges": f"with {MEMORY}, {_BRIGHT} select from_id, to_id, relation, strength, rank from r where rank <= 5",
    "structured_graph_nodes": f"with {MEMORY}, {_BRIGHT} select n.id, least(500, length(content)) as n_chars, coalesce(k, 0) as n_edges from n left join (select from_id, count(*) as k from r where rank <= 5 group by 1) on from_id = n.id",
    "unbound_antijoin": "select distinct id from entities where id not in (select entity_id from turn_entities where entity_id is not null)",
    "content_dedup": f"with {DOCS}, h as (select id, min(id) over (partition by content) as first_key from docs) select id, first_key from h where id <> first_key",
    "hash_change_detection": f"with {DOCS} select cast(id as varchar) as path from docs where provenance is distinct from 'internal' or lang is not distinct from 'fr'",
    "session_next_edges": "with t as (select session_id, turn_num, min(id) as id from conversation_turns where session_id is not null group by 1, 2), e as (select session_id, id as from_id, lead(id) over (partition by session_id order by turn_num nulls first, id) as to_id from t) select * from e where to_id is not null",
    "moment_entity_union": "with i as (select id, min(content) as content from conversation_turns group by 1), u as (select id, 1.0 as score from i where contains(lower(content), 'garden') union select turn_id, 0.8 from turn_entities where entity_id in (select id from entities where contains(lower(name), 'garden'))) select id, score from u order by score desc, id limit 200",
    "vector_knn": "with s as (select q.vec_id as query_id, v.vec_id as neighbour, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) as s from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0), r as (select *, row_number() over (partition by query_id order by s desc, neighbour) as rank from s) select query_id, neighbour, round(s, 4) as score, rank from r where rank <= 5",
    "visible_memories": f"with {DOCS} select id from docs where case when provenance = 'internal' then true when provenance = 'quarantine' then false else not coalesce(regexp_matches(lower(source), 'combined_text|prompt-logs|prompt_logs|calibration_run|dry-run|dry_run|tests/|weaver'), false) and not contains(content, 'thinking_content') and not contains(lower(content), '[planner]') and lang is not null end",
    "asof_link": "with s as (select event_id as s_id, epoch_us(ts) as s_us from events where event_type = 'purchase'), o as (select event_id as o_id, epoch_us(ts) as o_us from events where event_type <> 'purchase'), j as (select s_id, o_id, s_us - o_us as lag_us, row_number() over (partition by s_id order by o_us desc, o_id) as r from s join o on o_us between s_us - 600000000 and s_us) select s_id, o_id, lag_us from j where r = 1",
    "jaccard_link": r"""with d as (select doc_id as id, text as content, provenance as p from documents where text is not null),
 w as (select id, list_distinct(list_filter(string_split(lower(regexp_replace(content, '[^a-zA-Z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 2)) as ws, length(content) as n, cast(ceil(length(content) / 4) as bigint) * 4 as chars, p from d),
 j as (select s.id as s_id, o.id as o_id, len(list_intersect(s.ws, o.ws)) as b, len(s.ws) as x, len(o.ws) as y from w s join w o on s.p = 'external' and o.p <> 'external' and o.n >= greatest(200, floor(0.5 * s.chars)) and o.n <= floor(1.6 * s.chars) and len(s.ws) > 0 and len(o.ws) > 0),
 k as (select s_id, o_id, round(b / (x + y - b), 6) as score from j), r as (select *, row_number() over (partition by s_id order by score desc, o_id) as rn from k where score >= 0.18) select s_id, o_id, score from r where rn = 1""",
    "embed_link_delta": """with v as (select vec_id as id, cast(embedding as double[]) as e, vec_id % 7 as app, label from embeddings),
 n as (select s.id as s_id, o.id as o_id, s.e as se, o.e as oe, cast(s.app = o.app as int) as same, abs(s.id - o.id) as gap from v s join v o on s.label < 5 and o.label >= 5 and abs(s.id - o.id) <= 24),
 q as (select *, row_number() over (partition by s_id, same order by gap, o_id) as r from n), k as (select s_id, o_id, round(list_cosine_similarity(se, oe), 6) as score from q where r <= case when same = 1 then 100 else 200 end),
 b as (select *, row_number() over (partition by s_id order by score desc, o_id) as rank, coalesce(lead(score) over (partition by s_id order by score desc, o_id), 0) as second_score, count(*) over (partition by s_id) as num_candidates from k)
 select s_id, o_id, score, second_score, round(score - second_score, 6) as delta_diff, num_candidates, case when score < 0.3 then 'below_threshold' when num_candidates > 1 and round(score - second_score, 6) < 0.02 then 'below_delta' else 'ok' end as status from b where rank = 1""",
    "declared_link": r"""with w as (select distinct review_id, case when method = 'timestamp' then orig_app_id end as app, regexp_extract(orig_eid, ':(\d+)$', 1) as tail, orig_eid from weaver_review),
 s as (select review_id as s_id, app, case when tail <> '' and not regexp_matches(orig_eid, '[\n\t"]') then tail else orig_eid end as key from w),
 o as (select distinct try_cast(string_split(eid, ':')[-1] as bigint) as id, app_id from tmp_audit where try_cast(string_split(eid, ':')[-1] as bigint) is not null),
 a as (select app_id, min(id) as id from o group by 1), k as (select distinct id from o)
 select s_id, coalesce(a.id, k.id) as o_id, case when a.id is not null then 'app_id' else 'id' end as "by" from s left join a on a.app_id = s.app left join k on cast(k.id as varchar) = s.key where coalesce(a.id, k.id) is not null""",
    "run_rollback": "select s_eid, orig_eid from weaver_review where s_eid is not null and orig_eid is not null except select s_eid, orig_eid from weaver_review where status <> 'ok'",
    "committed_edges": "select distinct review_id, orig_eid in (select orig_eid from repair_canary_run2 where orig_eid is not null) and orig_eid is not null as found from weaver_review where status = 'ok'",
    "entity_upsert": rf"with {DOCS}, t as (select id, list_distinct(regexp_extract_all(content, '#(\w+)')) as x from docs), e as (select distinct id, unnest(x) as name from t) select lower(name) as key, min(name) as name, count(distinct id) as n from e group by 1",
    "date_interpolate": """with e as (select user_id, event_id, case when event_type = 'purchase' then epoch_us(ts) end as k, min(event_id) over (partition by user_id) as lo, max(event_id) over (partition by user_id) as hi from events),
 f as (select *, coalesce(k, case when event_id = lo then epoch_us(timestamp '2024-01-01') when event_id = hi then epoch_us(timestamp '2024-01-31') end) as t from e),
 w as (select *, last_value(t ignore nulls) over b as a_t, last_value(case when t is not null then event_id end ignore nulls) over b as a_p, first_value(t ignore nulls) over f2 as b_t, first_value(case when t is not null then event_id end ignore nulls) over f2 as b_p from f
 window b as (partition by user_id order by event_id rows between unbounded preceding and current row), f2 as (partition by user_id order by event_id rows between current row and unbounded following))
 select event_id, cast(round(a_t + (b_t - a_t) * case when b_p > a_p then (event_id - a_p) / cast(b_p - a_p as double) else 0 end) as bigint) as filled_us, k is null as is_estimated from w""",
}


def _searched(sent: list, keep: str = _OPEN, budget: int = 8000, k_anchor: int | None = None) -> str:
    """The best rows of each request's first attempt that finds anything, and their walk, in SQL."""
    n_anchor, n_walk = Q.sizes(budget)[1:]
    terms = [(r.query_id, r.part, a, t, len(set(ts))) for r in sent for a, ts in enumerate(r.attempts or Q.strategies(r.text, TODAY), 1) for t in dict.fromkeys(ts)]
    lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::varchar[]"
    asked = ", ".join(f"({r.query_id}, {r.part}, {lists(r.buckets)}, {lists(r.tags)})" for r in sent)
    may = "(len(r.bs) = 0 or list_has_any(m.buckets, r.bs)) and (len(r.gs) = 0 or list_has_any(m.tags, r.gs))"
    return rf"""
asked(query_id, part, bs, gs) as (values {asked}),
terms(query_id, part, attempt, term, n_terms) as (values {", ".join(f"({q}, {p}, {a}, '{t}', {n})" for q, p, a, t, n in terms)}),
word as (select id, unnest(string_split(lower(regexp_replace(content, '[^a-zA-Z0-9]+', ' ', 'g')), ' ')) as term from docs),
post as (select term, id, count(*) as tf from word where term in (select term from terms) group by 1, 2),
idf as (select term, ln(1 + (select count(*) from docs) / cast(count(*) as double)) as w from post group by 1),
fts as (select query_id, part, attempt, id, round(sum(tf * w), 6) as fts from post join terms using (term) join idf using (term) group by query_id, part, attempt, n_terms, id having count(*) = n_terms),
open as (select * from memory where {keep}),
hit as (select f.*, m.tags from fts f join open m using (id) join asked r using (query_id, part) where {may}),
first as (select query_id, part, min(attempt) as attempt from hit group by 1, 2),
anchors as (select query_id, part, attempt, id, tags, round(70 * fts, 6) as score from (select *, row_number() over (partition by query_id, part order by round(70 * fts, 6) desc, id) as rk from hit join first using (query_id, part, attempt)) where rk <= {k_anchor or n_anchor}),
seed as (select distinct query_id, part, unnest(tags) as tag from anchors),
near as (select distinct s.query_id, s.part, m.id from (select id, buckets, tags, unnest(tags) as tag from open) m join seed s using (tag) join asked r on r.query_id = s.query_id and r.part = s.part where {may}),
walk as (select * from (select *, row_number() over (partition by query_id, part order by id) as rk from near where not exists (select 1 from anchors a where a.query_id = near.query_id and a.part = near.part and a.id = near.id)) where rk <= {n_walk}),
both_ways as (select query_id, part, id, attempt, score from anchors union all select query_id, part, id, 0, 30.0 from walk),
found as (select b.query_id, b.part, b.id, b.attempt, b.score * (case when provenance = 'internal' then 2.0 else 1.0 end) * {_KIND} as score from both_ways b join memory using (id))
"""


_SENT = [R.routed(r, KEYWORDS, TODAY) for r in ROUTED]
_SPLIT = [*REQUESTS, *[R.Request(r.query_id, e, attempts=[[e]], part=i) for r in REQUESTS for i, e in enumerate(Q.entities(r.text), 1)]]
_PIECES = {(i, 1): Q.keywords(p, TODAY) for i, p in enumerate(Q.molecules("the pressure queue, the glossary page; a snapshot of the pump"))}
_EXACT = " union all ".join(
    f"select {r.query_id} as query_id, id, 200.0 as score from memory where lower(trim(bucket, ' ')) = '{r.text.lower()}' and list_has_all(tags, {list(r.tags)}::varchar[]) and list_has_all(buckets, {list(r.buckets)}::varchar[])" for r in _SENT
)
SQL |= {
    "searched_scored": f"with {MEMORY}, {_searched(REQUESTS)} select query_id, id, attempt, round(score, 4) as score from found",
    "routed_search": f"with {MEMORY}, {_searched(_SENT)}, exact as ({_EXACT}) select * from exact union all select query_id, id, round(score, 4) from found f where not exists (select 1 from exact x where x.query_id = f.query_id and x.id = f.id)",
    "smart_split_union": f"with {MEMORY}, {_searched(_SPLIT)}, n as (select query_id, count(*) filter (part = 0) as n from found group by 1), u as (select *, row_number() over (partition by query_id, id order by part, score desc) as rn from found join n using (query_id) where part = 0 or n < 10) select query_id, id, round(score, 4) as score, case when n < 10 then 12000 else 8000 end as budget from u where rn = 1",
    "molecule_pieces": f"with {MEMORY}, {_searched([R.Request(q, '', attempts=[t]) for (q, _), t in _PIECES.items()], k_anchor=10)}, u as (select *, row_number() over (partition by id order by query_id) as rn from anchors) select 7 as query_id, query_id as piece, id, score from u where rn = 1",
    "anchor_by_number": r"""with m as (select id, v.content as content, v.type as type, v.numeric_value as x from (select id, max({'content': content, 'type': type, 'numeric_value': numeric_value, 'numeric_unit': numeric_unit}) as v from molecule where content is not null group by 1)),
 w as (select id, unnest(string_split(lower(regexp_replace(content, '[^a-zA-Z0-9]+', ' ', 'g')), ' ')) as term from m), t(query_id, term) as (values (1, 'pressure'), (2, 'queue'), (3, 'valve')), p as (select query_id, term, id, count(*) as tf from w join t using (term) group by 1, 2, 3),
 i as (select term, ln(1 + (select count(*) from m) / cast(count(*) as double)) as idf from p group by 1), s as (select query_id, id, round(70 * round(tf * idf, 6), 6) as score, type, round(x, 4) as numeric_value, row_number() over (partition by query_id order by round(70 * round(tf * idf, 6), 6) desc, id) as rk from p join i using (term) join m using (id) where type = 'data' and x >= 10 and x <= 5000)
 select query_id, id, score, type, numeric_value from s where rk <= 15""",
    "pack_recent": f"""with {MEMORY}, {_FTS}, {_anchors(40, _OPEN)}, {_PACK.format(budget=int(1200 * 0.95) * 4).replace('0.7 * score + 0.3 *', '0.4 * score + 0.6 *')},
 txt as (select *, case when over_at is null or rk < over_at then content when stop - 1 > room * 0.5 then substr(content, 1, stop) || ' [Truncated]' else head || '...' end as packed from pk where n_chars is not null)
 select query_id, string_agg('[Source: ' || coalesce(source, '') || '] (' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z)' || chr(10) || packed, chr(10) || chr(10) order by ts_us, id) as prompt, sum(length(packed)) as n_chars from txt group by 1""",
    "hybrid_rerank": f"""with {MEMORY}, {_FTS}, {_anchors(8, 'true')},
 v as (select q.vec_id as query_id, v.vec_id as id, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) as s from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0), v8 as (select query_id, id, s as score from (select *, row_number() over (partition by query_id order by s desc, id) as rk from v) where rk <= 8),
 u as (select query_id, v8.id, score, docs.id % 11 as importance, 0 as branch from v8 left join docs using (id) union all select query_id, id, score, id % 11, 1 from anchors), f as (select query_id, id, round(score + 0.2 * coalesce(importance, 0) / 10, 6) as score from (select *, row_number() over (partition by query_id, id order by branch, score desc) as rn from u) where rn = 1),
 rec as (select 99 as query_id, id, 0.0 as score from (select id, row_number() over (partition by bucket order by ts desc nulls last, id) as rk from docs) where rk <= 3), al as (select * from f union all select * from rec where 99 not in (select query_id from f)),
 r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from al) select query_id, id, round(score, 4) as score, rank from r where rank <= 10""",
    "legacy_search": f"with {MEMORY}, {_searched([R.Request(1, '', attempts=[['pressure']]), R.Request(2, '', attempts=[['queue']])], keep="bucket in ('field', 'notes')", k_anchor=40)} select a.query_id, a.id, f.fts from anchors a join fts f using (query_id, id)",
    "weave_links": f"with k as ({SQL['embed_link_delta']}), t as (select s.vec_id as s_id, max(o.vec_id) as t_id from embeddings s join embeddings o on s.label < 5 and o.label >= 5 and o.vec_id between s.vec_id - 24 and s.vec_id group by 1), s as (select vec_id as s_id from embeddings where label < 5) select s_id, case when k.status = 'ok' then k.o_id else t_id end as o_id, case when k.status = 'ok' then 'vector' when t_id is not null then 'timestamp' else 'none' end as method, case when k.status = 'ok' then k.score end as score, case when k.status = 'ok' then 'ok' when t_id is not null then coalesce(k.status, 'no_candidate') else 'unlinked' end as status from s left join k using (s_id) left join t using (s_id)",
}
