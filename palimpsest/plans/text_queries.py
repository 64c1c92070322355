"""Text kernels over the documents and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as X
from ..operators import dedup, graph
from ..session import strip, table
from ..sources import files as S
from .base import DOCS, HITS, KEYWORDS, TYPE, docs, joined, memory

c = F.col


def content_ids(spark, d):
    return docs(spark, d).select(
        "id", F.concat(F.lit("mem_"), F.md5(F.concat("content", F.coalesce("source", F.lit(""))))).alias("compound_id"), F.concat(F.lit("atom_"), F.substring(F.sha2(F.coalesce("source", F.lit("")), 256), 1, 12)).alias("atom_id"),
        F.sha2("content", 256).alias("content_hash"), F.concat(F.lit("file_"), F.replace(F.base64(F.encode(F.coalesce("source", F.lit("")), "UTF-8")), F.lit("="), F.lit(""))).alias("file_id"),
    )


def pii_mask(spark, d):
    marked = F.concat("content", F.lit(" mail a.b@c-d.org, 10.0.0.1 sk-"), F.repeat(F.lit("a1"), 20))
    return docs(spark, d).select("id", X.mask_personal(marked).alias("masked"))


def detect_type(spark, d):
    return docs(spark, d).select("id", X.molecule_type(c("content"), c("source")).alias("type"))


def numeric_extract(spark, d):
    n = X.numeric(c("content"))
    return table(spark, d, "molecule").where("content is not null").select("id", "content").distinct().select("id", F.round(n.value, 4).alias("value"), n.unit.alias("unit"))


def hashtag_extract(spark, d):
    return docs(spark, d).select("id", joined(X.hashtags(c("content"))).alias("tags")).where("tags <> ''")


def keyword_infect(spark, d):
    return docs(spark, d).select("id", joined(X.keyword_hits(c("content"), KEYWORDS)).alias("tags")).where("tags <> ''")


def year_tags(spark, d):
    return docs(spark, d).select("id", joined(F.array_sort(X.years(c("content")))).alias("years")).where("years <> ''")


def infected_tags(spark, d):
    from ..operators import organize as O

    m = docs(spark, d).withColumn("tags", F.array(F.lit("note")))
    return O.infect(m, KEYWORDS).select("id", joined(F.array_sort("new_tags")).alias("tags"))


def scan_tags(spark, d):
    return docs(spark, d).select("id", joined(F.array_sort(X.scan_tags(c("content"), KEYWORDS))).alias("tags"))


def system_tags_from_path(spark, d):
    p = F.concat(F.lit("work/"), "source")
    return docs(spark, d).where("source is not null").select("id", joined(X.system_tags(p)).alias("tags"))


def bucket_from_path(spark, d):
    return docs(spark, d).where("source is not null").select("id", X.path_bucket(c("source")).alias("path_bucket"), X.watch_provenance(c("source")).alias("watch_provenance"), X.provenance(c("source"), c("lang")).alias("trust"))


def display_tags(spark, d):
    tags = F.concat(F.split("content", " "), F.array(F.lit("2024"), F.lit("note")))
    return docs(spark, d).select("id", F.size(X.display_tags(F.filter(tags, lambda t: t.rlike("^[0-9a-z]{4}$")))).alias("n"))


def split_sentences(spark, d):
    parts = K.split_text(c("content"), F.lit("prose"), F.lit(False))
    return docs(spark, d).select("id", F.posexplode(parts).alias("sequence", "p")).select("id", "sequence", "p.content")


def sentence_offsets(spark, d):
    """How many sentences each document has, and of how many the place gives back the content."""
    parts = K.split_text(c("content"), F.lit("prose"), F.lit(False))
    e = docs(spark, d).select("id", "content", F.explode(parts).alias("p"))
    right = F.substring("content", c("p.start") + 1, c("p.end") - c("p.start")) == c("p.content")
    return e.groupBy("id").agg(F.count("*").alias("n"), F.count(F.when(right, 1)).alias("n_right"))


def split_rows(spark, d):
    parts = K.split_text(c("content"), F.lit("data"), F.lit(False))
    return docs(spark, d).select("id", F.posexplode(parts).alias("sequence", "p")).select("id", "sequence", c("p.content").alias("content"), c("p.start").alias("start"))


def split_code(spark, d):
    parts = K.split_text(c("content"), F.lit("code"), F.lit(False))
    return docs(spark, d).select("id", F.posexplode(parts).alias("sequence", "p")).select("id", "sequence", "p.content", "p.start", "p.end")


def split_fences(spark, d):
    parts = K.split_text(c("content"), F.lit("prose"), F.lit(True))
    return docs(spark, d).where(c("content").contains("```")).select("id", F.posexplode(parts).alias("sequence", "p")).select("id", "sequence", "p.content", "p.start", "p.end")


def _chunks(fn):
    def q(spark, d):
        return docs(spark, d).select("id", F.posexplode(K.chunker(fn)("content")).alias("sequence", "chunk"))

    return q


def simhash_fingerprint(spark, d):
    return docs(spark, d).select("id", K.simhash("content").alias("simhash"), F.lower(F.hex(K.simhash("content"))).alias("hex"))


def simhash_neardup(spark, d):
    h = docs(spark, d).select("id", K.simhash("content").alias("simhash"))
    return dedup.near_pairs(h)


def simhash_classes(spark, d):
    h = docs(spark, d).select("id", K.simhash("content").alias("simhash"))
    links = dedup.near_pairs(h)
    n = links.select(c("a").alias("simhash")).unionByName(links.select(c("b").alias("simhash"))).groupBy("simhash").agg(F.count("*").alias("n_near"))
    return dedup.classes(h).join(n, "simhash", "left").select("id", "first_key", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def _page(spark, d):
    """Every document's text, escaped, as the body of a page."""
    text = c("content")
    for raw, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(named))
    html = F.concat(F.lit("<html><head><title>Doc "), "id", F.lit("</title><meta name='description' content='About "), "id", F.lit("'><script>var a='</p>';</script></head><body><nav>menu</nav><main><h1>Head</h1><p>"), text, F.lit("</p></main></body></html>"))
    return docs(spark, d).select("id", S.page(html).alias("p"))


def html_to_text(spark, d):
    return _page(spark, d).select("id", "p.text")


def html_title(spark, d):
    return _page(spark, d).select("id", "p.title", "p.description")


def html_markdown(spark, d):
    return _page(spark, d).select("id", "p.markdown")


def temporal_tags(spark, d):
    return table(spark, d, "events").select("event_id", joined(X.temporal_tags(c("ts"))).alias("tags"))


def clean_sanitize(spark, d):
    return docs(spark, d).select("id", X.sanitize(c("content"), F.coalesce("source", F.lit(""))).alias("clean"))


def clean_text(spark, d):
    return docs(spark, d).select("id", X.clean_content(c("content")).alias("cleaned"))


def technical_normalised(spark, d):
    return docs(spark, d).select("id", X.normalize_technical(c("content")).alias("text"))


def fts_query_clean(spark, d):
    return docs(spark, d).select("id", X.fts_query(c("content")).alias("q"))


def quality_audit(spark, d):
    a = table(spark, d, "tmp_audit").where("snippet is not null").select("eid", "snippet").distinct()
    s = c("snippet")
    return a.select(
        "eid", X.json_like(s).alias("json_like"), X.html_like(s).alias("html_like"), F.round(X.non_ascii_ratio(s), 4).alias("non_ascii_ratio"), X.spam_hits(s).alias("spam_keywords"), X.technical_signal(s).alias("technical_signal"),
    )


def suspect_counts(spark, d):
    a = table(spark, d, "tmp_audit").where("snippet is not null").select("eid", "snippet").distinct()
    s = c("snippet")
    n = lambda x: F.count(F.when(x, 1))
    return a.agg(n(X.json_like(s)).alias("json_like"), n(X.html_like(s)).alias("html_like"), n(F.round(X.non_ascii_ratio(s), 4) > 0.3).alias("non_ascii_high"), n(X.spam_hits(s) != "").alias("spam"), n(X.suspect(s)).alias("suspect"))


def token_soup(spark, d):
    a = table(spark, d, "token_soup_scan").where("original_excerpt is not null").select("eid", "original_excerpt").distinct()
    return a.select("eid", X.token_soup(c("original_excerpt")).alias("soup"))


def soup_sanitised(spark, d):
    a = table(spark, d, "token_soup_scan").where("original_excerpt is not null").select("eid", "original_excerpt").distinct()
    return a.where(X.token_soup(c("original_excerpt"))).select("eid", X.strip_soup(c("original_excerpt")).alias("rest"))


def entity_extract(spark, d):
    return docs(spark, d).select("id", F.posexplode(X.entities(c("content"))).alias("position", "entity"))


def content_dates(spark, d):
    return docs(spark, d).select("id", F.date_format(X.content_date(c("content")), "yyyy-MM-dd").alias("day")).where("day is not null")


def token_estimates(spark, d):
    return docs(spark, d).select("id", X.token_estimate(c("content")).alias("tokens"), X.word_token_estimate(c("content")).alias("word_tokens"))


def file_classes(spark, d):
    return docs(spark, d).where("source is not null").select("id", X.file_class(c("source"), c("content")).alias("kind"))


def conversation_files(spark, d):
    return docs(spark, d).where(X.is_conversation(c("content"))).select("id")


def compact_summaries(spark, d):
    return docs(spark, d).select("id", X.first_sentences(c("content"), 2).alias("summary"))


def chunk_strategies(spark, d):
    return docs(spark, d).select("id", X.chunk_strategy(c("content")).alias("strategy"))


def topology_molecules(spark, d):
    m = docs(spark, d).withColumn("source", F.coalesce("source", F.lit("")))
    return graph.molecules(m, KEYWORDS).select("id", "compound_id", "sequence", "start", "end", "type", F.round("numeric_value", 4).alias("numeric_value"), "numeric_unit", joined("tags").alias("tags"), "simhash")


def _topology(spark, d, name):
    return graph.topology(docs(spark, d).withColumn("source", F.coalesce("source", F.lit(""))), KEYWORDS)[name]


def topology_edges(spark, d):
    return _topology(spark, d, "atom_edges")


def topology_compounds(spark, d):
    return _topology(spark, d, "compounds").select("id", F.md5("compound_body").alias("digest"), "path", joined(F.array_sort("tags")).alias("tags"))


def topology_atoms(spark, d):
    return _topology(spark, d, "atoms")


def topology_memory(spark, d):
    """Rows of the memory table by type, and whether every fragment's source is a document's."""
    return _topology(spark, d, "memory").groupBy("type").agg(F.count_distinct("source").alias("n_sources"), F.sum(F.when(c("type") == "compound", F.length("content"))).alias("chars"))


def flexible_timestamps(spark, d):
    """All values of both fields; a value that is no time has no ``us``."""
    r = table(spark, d, "repair_canary_run2")
    r = r.select("repair_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), strip(c(f)).alias("t")) for f in ("s_created_at", "orig_created_at")])).alias("x")).where("x.t is not null").distinct()
    return r.select("repair_id", "x.field", F.unix_micros(X.flexible_timestamp(c("x.t"))).alias("us"))


def uuid_app_ids(spark, d):
    return docs(spark, d).select("id", K.app_id(F.substring("content", 1, 4096)).alias("app_id"), K.fallback_hash(c("content")).alias("fallback"))


def char_similarity(spark, d):
    w = table(spark, d, "weaver_review").where("s_excerpt is not null and orig_excerpt is not null").select("review_id", "s_excerpt", "orig_excerpt").distinct()
    return w.select("review_id", F.round(K.char_similarity("s_excerpt", "orig_excerpt"), 6).alias("similarity"))


QUERIES = {
    f.__name__: f
    for f in (
        content_ids, pii_mask, detect_type, numeric_extract, hashtag_extract, keyword_infect, year_tags, infected_tags, scan_tags, system_tags_from_path, bucket_from_path, display_tags, split_sentences, sentence_offsets, split_rows,
        split_code, split_fences, simhash_fingerprint, simhash_neardup, simhash_classes, html_to_text, html_title, html_markdown, temporal_tags, clean_sanitize, clean_text, technical_normalised, fts_query_clean, quality_audit, suspect_counts,
        token_soup, soup_sanitised, entity_extract, content_dates, token_estimates, file_classes, conversation_files, compact_summaries, chunk_strategies, topology_molecules, topology_edges, topology_compounds, topology_atoms, topology_memory, flexible_timestamps, uuid_app_ids, char_similarity,
    )
} | {"chunk_prose": _chunks(K.chunk_prose), "chunk_code": _chunks(K.chunk_code), "chunk_paragraphs": _chunks(K.chunk_paragraphs), "chunk_overlapping": _chunks(K.chunk_overlapping)}

_MONTHS = "['january','february','march','april','may','june','july','august','september','october','november','december']"
_YEARS = r"list_distinct(regexp_extract_all(content, '\b((?:19|20)[0-9]{2})\b', 1))"
_TECH = "(" + " or ".join(f"contains(lower(snippet), '{k}')" for k in X.TECHNICAL) + r" or regexp_matches(snippet, 'v\d+\.\d+(\.\d+)?|/\w+/\w+|[A-Za-z]:\\\\|[\p{L}\p{N}_][$#] '))"
_JSON = r"""regexp_matches(snippet, '\{\s*".*"\s*:\s*|\[\s*\{|"response_content"|"timestamp"')"""
_HTML = r"""regexp_matches(snippet, '<\s*/?\w+[^>]*>|<a\s+href=|<script\b|<div\b|<p\b')"""
_HIGH = r"(case when length(snippet) > 0 then round(length(regexp_replace(snippet, '[\x00-\x7F]', '', 'g')) / length(snippet), 4) else 0 end)"
_SPAM = "list_filter([" + ", ".join(f"'{k}'" for k in X.SPAM) + "], lambda k: contains(lower(snippet), k))"
_EMOJI = r"(case when length(snippet) > 0 then round(len(regexp_extract_all(snippet, '[\x{1F300}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]')) / length(snippet), 4) else 0 end)"
_AUDIT = "a as (select distinct eid, snippet from tmp_audit where snippet is not null)"
_SOUP = r"""
s as (select distinct eid, original_excerpt, regexp_replace(original_excerpt, '^\s+|\s+$', '', 'g') as t from token_soup_scan where original_excerpt is not null),
k as (select *, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') as ts from s),
r as (select *, len(ts) as n, len(list_filter(ts, lambda x: regexp_matches(x, '[(){}\[\]<>;=:\\|/@#%$]'))) as code,
 len(list_filter(ts, lambda x: regexp_matches(x, '^(0x[0-9a-fA-F]{8,}|[A-Fa-f0-9]{16,})$'))) + len(list_filter(ts, lambda x: regexp_matches(x, '[0-9]') and not regexp_matches(x, '[A-Za-z]') and length(x) >= 8)) as hexes,
 len(list_filter(ts, lambda x: length(x) = 1)) as single, len(list_filter(ts, lambda x: length(x) >= 6 and not regexp_matches(x, '[aeiouAEIOU]'))) as no_vowel,
 len(list_filter(ts, lambda x: regexp_matches(x, '^[A-Za-z]+$'))) as alpha, len(list_filter(ts, lambda x: length(x) > 30)) as lengthy from k)
"""
_EXT = "lower(string_split(source, '.')[-1])"
#: A character that isn't white space.
_SEEN = r"[^\s\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f]"
_PARTS = "string_split('work/' || source, '/')"
_AT = f"list_filter(range(1, len({_PARTS}) + 1), lambda i: list_contains(['codebase','projects','repos','src','packages','apps','personal','work','client'], lower({_PARTS}[i])) and coalesce({_PARTS}[i + 1], '') <> '')"
_NUMBERS = r"""
m as (select distinct id, content from molecule where content is not null),
x as (select id, content, regexp_extract_all(content, '([\d,]+\.?\d*)\s?([A-Za-z%]+)?', 1) as v, regexp_extract_all(content, '([\d,]+\.?\d*)\s?([A-Za-z%]+)?', 2) as u from m),
p as (select id, content, list_filter(list_transform(range(1, len(v) + 1), lambda i: {'v': try_cast(replace(v[i], ',', '') as double), 'u': nullif(u[i], '')}), lambda s: s.v is not null and not (s.u is null and s.v between 1900 and 2100 and s.v = floor(s.v))) as s from x),
w as (select id, content, s, list_filter(s, lambda y: y.u is not null) as named from p)
"""
_BLANK = r"[\s\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0b\x1c-\x1f]"


def _steps(expr: str, steps) -> str:
    """Replacements in order, in SQL."""
    for old, new in steps:
        expr = f"regexp_replace({expr}, '{old.replace(chr(39), chr(39) * 2)}', '{new.replace(chr(39), chr(39) * 2)}', 'g')"
    return expr


# java's \s is ASCII with the vertical tab, its (?U)\s and \w are of Unicode
_S, _US, _UW = r"[ \t\n\x0b\f\r]", r"[\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}"
_EMOJIS = r"[\x{1F300}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]"
_FIELD = "coalesce(" + ", ".join(f"nullif(json_extract_string(j, '$.{k}'), '')" for k in ("response_content", "content", "text", "message", "response")) + ", t)"
_ENTITIES = [(r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;", "'")]
_CLEAN = rf"""
t0 as (select id, content as raw, regexp_replace(content, '^{_S}+|{_S}+$', '', 'g') as t from docs),
t1 as (select *, case when json_valid(t) then t end as j from t0),
clean as (select id, raw, coalesce(trim({_steps(f"case when regexp_matches(t, '^({{|[[])') or contains(t, '" + '"response_content"' + f"') then {_FIELD} else t end", [(r"<[^>]+>", " "), *_ENTITIES, (r"&nbsp;", " "), (r"&amp;", "&"), (_EMOJIS, ""), (rf"[^{_UW}{_US[1:-1]}.,;:\-'" + r'"@#%()?/\\]+', " "), (_US + "+", " ")])}), '') as cleaned from t1)
"""
_RUNS = r"\b[A-Z][a-z]+(?:[ \t\n\x0b\f\r]+[A-Z][a-z]+)*\b"
#: Letters beyond ASCII become one that a word border counts as a letter.
_FLAT = r"regexp_replace(content, '[\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\x{2FF}\x{300}-\x{36F}\x{370}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}\x{F900}-\x{FDFF}]', '_', 'g')"
_NAMED = rf"""
e00 as (select id, content, {_FLAT} as flat from docs),
e0 as (select id, content, list_concat(case when {_TECH.replace('snippet', 'content')} then list_concat(regexp_extract_all(flat, 'v?\d+\.\d+(?:\.\d+)?'), regexp_extract_all(content, '(?:/[\w.-]+){{2,}}'), regexp_extract_all(flat, '\b[a-z][a-z0-9]+(?:-[a-z0-9]+)+\b')) else []::varchar[] end, regexp_extract_all(flat, '{_RUNS}')) as xs from e00),
e1 as (select id, xs, list_transform(xs, lambda x: lower(x)) as ls from e0),
e2 as (select id, list_filter(xs, lambda x, i: list_position(ls, lower(x)) = i)[1:10] as names from e1)
"""
_FNV = r"""
w0 as (select id, content, list_filter(string_split_regex(content, '[ \n\t\r]'), lambda x: x <> '') as ws from docs),
v0 as (select distinct unnest(ws) as w from w0),
v1 as (select w, hex(encode(w)) as x from v0),
v2 as (select w, list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(1, length(x), 2), lambda i: cast('0x' || x[i:i + 1] as int)::uhugeint)), lambda h, b: (xor(h, case when b >= 128 then 18446744073709551360::uhugeint + b else b end) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)::ubigint as h from v1),
o0 as (select id, unnest(ws) as w from w0),
o1 as (select id, h, count(*) as n from o0 join v2 using (w) group by 1, 2),
o2 as (select id, sum(n) as total, """ + ", ".join(f"sum(case when (h >> {i}) & 1 = 1 then n else 0 end) as b{i}" for i in range(64)) + r""" from o1 group by 1),
o3 as (select id, (""" + " + ".join(f"(case when 2 * b{i} > total then {1 << i}::uhugeint else 0::uhugeint end)" for i in range(64)) + r""")::ubigint as u from o2),
prints as (select d.id, coalesce(u, 0::ubigint) as u, (case when u >= 9223372036854775808 then u::hugeint - 18446744073709551616::hugeint else coalesce(u, 0)::hugeint end)::bigint as simhash from docs d left join o3 using (id)),
classes as (select simhash, u, count(*) as n, min(id) as first_key from prints group by 1, 2),
near as (select a.simhash as a, b.simhash as b, bit_count(xor(a.u, b.u)) as distance from classes a join classes b on a.simhash < b.simhash and a.u <> 0 and b.u <> 0 where bit_count(xor(a.u, b.u)) <= 2)
"""


def _shorten(c: str, pattern: str, longest: int, keep: int) -> str:
    found = f"regexp_extract_all({c}, '{pattern}')"
    cut = f"list_transform({found}, lambda m: case when length(m) > {longest} then substr(m, 1, {keep}) || '...' else m end)"
    return f"(case when len(list_filter({found}, lambda m: length(m) > {longest})) > 0 then array_to_string(list_transform(list_zip(string_split_regex({c}, '{pattern}'), {cut}), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '') else {c} end)"


_WIN, _UNIX = r"[A-Za-z]:[\\/](?:[\w\-.@ ]+[\\/])+[\w\-.@ ]+", r"/(?:[\w\-.@]+/)+[\w\-.@]+"
_DUMP = r"(?:0x[0-9a-fA-F]{2,}|[0-9A-Fa-f]{2,}(?:\s+[0-9A-Fa-f]{2,}){4,})"
_ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
_PLAIN = rf"""
n0 as (select id, content as snippet, regexp_matches(content, '{_ANSI}') as ansi, regexp_matches(content, '[A-Za-z]:[\\/]') as win, regexp_matches(content, '/usr/|/bin/|/home/|{_UNIX}') as unix, regexp_matches(content, '{_DUMP}') as dump from docs),
n1 as (select *, {_HTML} as html, list_filter([case when dump then '[Binary Data Omitted]' end, case when {_HTML} then '[Context: HTML]' end, case when ansi then '[Context: Terminal Output]' end, case when unix then '[OS: Linux]' end, case when win then '[OS: Windows]' end], lambda x: x is not null) as notes, regexp_replace(snippet, '{_ANSI}', ' ', 'g') as t from n0),
n2 as (select id, html, unix, notes, case when win then {_shorten("t", _WIN, 70, 60)} else t end as t from n1),
n3 as (select id, html, notes, regexp_replace(case when unix then {_shorten("t", _UNIX, 80, 80)} else t end, '{_DUMP}', '[binary_data]', 'g') as t from n2),
n4 as (select id, notes, case when html then regexp_replace(t, '<[^>]+>', ' ', 'g') else t end as t from n3),
n5 as (select id, notes, trim({_steps("t", [(r"[\x00\x07\x0b\x0c]", " "), *_ENTITIES, (r"&amp;", "&"), (_US + "+", " ")])}, ' ') as t from n4)
"""
_TAGS = rf"""
p as (select id, content, provenance, coalesce(source, '') as source, coalesce(source, '') as path from docs),
g as (select 'mem_' || md5(content || source) as from_id, content, source, list_distinct(list_filter(list_concat(list_transform({HITS}, lambda k: '#' || k), regexp_extract_all(content, '#(\w+)'),
 [case when contains(lower(path), '/history/') or contains(lower(path), '/archive/') then '#Archive' end, case when len(h) > 0 then '#project:' || parts[h[1] + 1] end,
 case when contains(path, '/src/') or starts_with(path, 'src/') then '#src' end, case when contains(path, '/docs/') or starts_with(path, 'docs/') then '#docs' end, case when contains(path, '/tests/') or starts_with(path, 'tests/') then '#test' end,
 case when {_EXT} in ('ts','js','py','rs','go','java','cpp','c','h') then '#code' when {_EXT} in ('md','txt','rst') then '#doc' when {_EXT} in ('json','yaml','yml','xml') then '#config' end]), lambda x: x is not null)) as tags
 from (select *, string_split(source, '/') as parts, list_filter(range(1, len(string_split(source, '/')) + 1), lambda i: list_contains(['codebase','projects','repos','src','packages','apps','personal','work','client'], lower(string_split(source, '/')[i])) and coalesce(string_split(source, '/')[i + 1], '') <> '') as h from p))
"""
SQL = {
    "content_ids": f"with {DOCS} select id, 'mem_' || md5(content || coalesce(source, '')) as compound_id, 'atom_' || substr(sha256(coalesce(source, '')), 1, 12) as atom_id, sha256(content) as content_hash, 'file_' || replace(to_base64(encode(coalesce(source, ''))), '=', '') as file_id from docs",
    "pii_mask": rf"with {DOCS}, m as (select id, content || ' mail a.b@c-d.org, 10.0.0.1 sk-' || repeat('a1', 20) as t from docs) select id, regexp_replace(regexp_replace(regexp_replace(t, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b', '[EMAIL_REDACTED]', 'g'), '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b', '[IP_REDACTED]', 'g'), 'sk-[a-zA-Z0-9]{{32,}}', 'sk-[REDACTED]', 'g') as masked from m",
    "detect_type": f"with {DOCS} select id, {TYPE} as type from docs",
    "numeric_extract": f"with {_NUMBERS} select id, round(case when len(named) > 0 then named[-1].v else s[1].v end, 4) as value, case when len(named) > 0 then named[-1].u else s[1].u end as unit from w",
    "hashtag_extract": rf"with {DOCS}, t as (select id, regexp_extract_all(content, '#(\w+)') as x from docs), p as (select id, list_filter(x, lambda v, i: list_position(x, v) = i) as y from t) select id, array_to_string(y, '|') as tags from p where len(y) > 0",
    "keyword_infect": f"with {DOCS} select id, array_to_string({HITS}, '|') as tags from docs where len({HITS}) > 0",
    "year_tags": f"with {DOCS} select id, array_to_string(list_sort({_YEARS}), '|') as years from docs where len({_YEARS}) > 0",
    "infected_tags": rf"with {DOCS}, t as (select id, list_distinct(list_concat(['note'], {HITS}, {_YEARS}, list_transform(list_filter({_MONTHS}, lambda m: regexp_matches(lower(content), '\b' || m || '\b')), lambda m: upper(m[1]) || m[2:]))) as x from docs) select id, array_to_string(list_sort(x), '|') as tags from t where len(x) > 1",
    "scan_tags": rf"with {DOCS} select id, array_to_string(list_sort(list_distinct(list_concat(list_transform({HITS}, lambda k: '#' || k), regexp_extract_all(content, '#(\w+)')))), '|') as tags from docs",
    "system_tags_from_path": f"""with {DOCS}, p as (select id, source, 'work/' || source as path, {_PARTS} as parts, {_AT} as hits from docs where source is not null)
 select id, array_to_string(list_filter([case when contains(lower(path), '/history/') or contains(lower(path), '/archive/') then '#Archive' end, case when len(hits) > 0 then '#project:' || parts[hits[1] + 1] end,
 case when contains(path, '/src/') or starts_with(path, 'src/') then '#src' end, case when contains(path, '/docs/') or starts_with(path, 'docs/') then '#docs' end, case when contains(path, '/tests/') or starts_with(path, 'tests/') then '#test' end,
 case when {_EXT} in ('ts','js','py','rs','go','java','cpp','c','h') then '#code' when {_EXT} in ('md','txt','rst') then '#doc' when {_EXT} in ('json','yaml','yml','xml') then '#config' end], lambda x: x is not null), '|') as tags from p""",
    "bucket_from_path": rf"with {DOCS}, p as (select id, source, string_split(source, '/') as parts from docs where source is not null) select id, case when len(parts) < 2 then 'notebook' when parts[1] in ('inbox', 'external-inbox') and len(parts) > 2 then parts[2] else parts[1] end as path_bucket, case when contains(source, 'inbox') and not contains(source, 'external-inbox') then 'internal' else 'external' end as watch_provenance, case when regexp_matches(source, '(^|/)(internal-)?inbox/') then 'internal' else 'external' end as trust from p",
    "display_tags": f"with {DOCS} select id, len(list_filter(list_concat(string_split(content, ' '), ['2024', 'note']), lambda t: regexp_matches(t, '^[0-9a-z]{{4}}$') and not regexp_matches(t, '^[0-9]{{4}}$'))) as n from docs",
    "split_sentences": rf"with {DOCS}, m as (select id, string_split(regexp_replace(content, '([.!?])([\s\x85\xA0\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x1c-\x1f]+)([A-Z])', chr(1) || '\1' || chr(2) || '\3', 'g'), chr(2)) as x from docs), p as (select id, unnest(list_filter(list_transform(x, lambda s: replace(s, chr(1), '')), lambda s: regexp_matches(s, '{_SEEN}'))) as content, generate_subscripts(list_filter(x, lambda s: regexp_matches(replace(s, chr(1), ''), '{_SEEN}')), 1) - 1 as sequence from m) select id, sequence, content from p",
    "split_rows": rf"with {DOCS}, l as (select id, string_split(content, chr(10)) as x from docs), p as (select id, unnest(x) as content, generate_subscripts(x, 1) as i, x from l), o as (select id, i, content, coalesce(list_sum(list_transform(x[1:i - 1], lambda s: length(s) + 1)), 0) as start from p) select id, row_number() over (partition by id order by i) - 1 as sequence, content, start from o where regexp_matches(content, '[^\s\x85\xA0\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x1c-\x1f]')",
    "html_title": f"with {DOCS} select id, 'Doc ' || id as title, 'About ' || id as description from docs",
    "html_to_text": f"with {DOCS} select id, trim(regexp_replace('menu Head ' || content, '{_BLANK}+', ' ', 'g')) as text from docs",
    "topology_memory": f"with {DOCS}, {_TAGS}, k as (select distinct from_id, content, source from g) select 'compound' as type, count(distinct source) as n_sources, sum(length(content)) as chars from k union all select 'fragment', count(distinct source), null from k where regexp_matches(content, '{_SEEN}')",
    "technical_normalised": f"with {DOCS}, {_PLAIN} select id, case when len(notes) > 0 then array_to_string(notes, ' ') || ' ' || t else t end as text from n5",
    "clean_text": f"with {DOCS}, {_CLEAN} select id, cleaned from clean",
    "soup_sanitised": rf"""with {_SOUP}, k2 as (select eid, original_excerpt as o from r where length(t) >= 40 and n >= 3 and (code / n > 0.25 or hexes / n > 0.05 or single / n > 0.25 or (alpha / n < 0.25 and (no_vowel / n > 0.2 or lengthy / n > 0.05)) or regexp_matches(t, '[^\w\s]{{6,}}'))),
 x as (select eid, trim({_steps("o", [("(?s)```.*?```", " "), (r"\b[A-Za-z_][A-Za-z0-9_]*\([^)]*\)", " "), (r"0x[0-9a-fA-F]{6,}", " "), (r"\b[A-Fa-f0-9]{16,}\b", " "), (r"[<>|\\]+", " "), (rf"[^{_UW}{_US[1:-1]}.,;:\-'" + r'"()]+', " "), (_US + "+", " ")])}) as t from k2) select eid, case when length(t) > 500 then substr(t, 1, 500) || '...' else t end as rest from x""",
    "entity_extract": f"with {DOCS}, {_NAMED} select id, unnest(names) as entity, generate_subscripts(names, 1) - 1 as position from e2",
    "content_dates": rf"""with {DOCS}, h as (select id, substr(content, 1, 2000) as t from docs),
 x as (select id, regexp_extract(t, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1) as iso, regexp_extract(t, '\b(\d{{1,2}}/\d{{1,2}}/\d{{4}})\b', 1) as us, regexp_extract(t, '\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? \d{{1,2}},? \d{{4}})\b', 1) as name from h),
 y as (select id, case when iso <> '' then try_strptime(iso, '%Y-%m-%d') when us <> '' then try_strptime(us, '%m/%d/%Y') when name <> '' then try_strptime(substr(name, 1, 3) || ' ' || regexp_extract(name, '(\d{{1,2}}),? (\d{{4}})$', 1) || ' ' || regexp_extract(name, '(\d{{4}})$', 1), '%b %d %Y') end as day from x)
 select id, strftime(day, '%Y-%m-%d') as day from y where day is not null""",
    "compact_summaries": rf"""with {DOCS}, x as (select id, string_split(regexp_replace(trim(content, ' '), '([.!?]){_S}+', '\1' || chr(1), 'g'), chr(1)) as xs from docs) select id, array_to_string(xs[1:2], ' ') as summary from x""",
    "char_similarity": """with w as (select distinct review_id, s_excerpt as a, orig_excerpt as b from weaver_review where s_excerpt is not null and orig_excerpt is not null), n as (select *, row_number() over () as k from w),
 ca as (select k, ch, count(*) as m from (select k, unnest(string_split(a, '')) as ch from n where a <> '') group by 1, 2), cb as (select k, ch, count(*) as m from (select k, unnest(string_split(b, '')) as ch from n where b <> '') group by 1, 2),
 s as (select k, sum(least(ca.m, cb.m)) as common from ca join cb using (k, ch) group by 1) select review_id, round(case when a = '' and b = '' then 1 else 2 * coalesce(common, 0) / (length(a) + length(b)) end, 6) as similarity from n left join s using (k)""",
    "simhash_fingerprint": f"with {DOCS}, {_FNV} select id, simhash, lower(to_hex(u)) as hex from prints",
    "simhash_neardup": f"with {DOCS}, {_FNV} select a, b, distance from near",
    "simhash_classes": f"with {DOCS}, {_FNV}, m as (select s as simhash, count(*) as n_near from (select a as s from near union all select b from near) group by 1) select p.id, c.first_key, c.n, coalesce(n_near, 0) as n_near from prints p join classes c using (simhash) left join m using (simhash)",
    "topology_compounds": f"with {DOCS}, {_TAGS} select distinct from_id as id, md5(content) as digest, source as path, array_to_string(list_sort(tags), '|') as tags from g",
    "topology_atoms": f"with {DOCS}, {_TAGS}, l as (select distinct unnest(tags) as label from g) select 'atom_' || substr(sha256(label), 1, 12) as id, label, case when starts_with(label, '#project:') or label in ('#Archive', '#src', '#docs', '#test', '#code', '#doc', '#config') then 'system' else 'concept' end as type, case when label = '#Archive' then 0.5 else 1.0 end as weight from l",
    "temporal_tags": "select event_id, array_to_string([cast(year(ts) as varchar), monthname(ts), dayname(ts), case when month(ts) in (3,4,5) then 'Spring' when month(ts) in (6,7,8) then 'Summer' when month(ts) in (9,10,11) then 'Autumn' else 'Winter' end, 'Q' || quarter(ts), case when hour(ts) between 5 and 11 then 'Morning' when hour(ts) between 12 and 16 then 'Afternoon' when hour(ts) between 17 and 20 then 'Evening' else 'Night' end], '|') as tags from events",
    "fts_query_clean": rf"with {DOCS} select id, lower(trim(regexp_replace(regexp_replace(content, '[^a-zA-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) as q from docs",
    "quality_audit": f"with {_AUDIT} select eid, {_JSON} as json_like, {_HTML} as html_like, {_HIGH} as non_ascii_ratio, array_to_string({_SPAM}, ',') as spam_keywords, {_TECH} as technical_signal from a",
    "suspect_counts": f"with {_AUDIT} select count(*) filter ({_JSON}) as json_like, count(*) filter ({_HTML}) as html_like, count(*) filter ({_HIGH} > 0.3) as non_ascii_high, count(*) filter (len({_SPAM}) > 0) as spam, count(*) filter ((({_JSON} or {_HTML}) and not {_TECH}) or {_HIGH} > 0.3 or {_EMOJI} > 0.05 or len({_SPAM}) > 0) as suspect from a",
    "token_soup": rf"with {_SOUP} select eid, length(t) >= 40 and n >= 3 and (code / n > 0.25 or hexes / n > 0.05 or single / n > 0.25 or (alpha / n < 0.25 and (no_vowel / n > 0.2 or lengthy / n > 0.05)) or regexp_matches(t, '[^\w\s]{{6,}}')) as soup from r",
    "token_estimates": rf"with {DOCS} select id, cast(ceil(length(content) / 4) as bigint) as tokens, len(regexp_extract_all(content, '\S+')) + cast(ceil(length(content) / 4) as bigint) as word_tokens from docs",
    "file_classes": f"with {DOCS} select id, case when {_EXT} in ('yaml', 'yml') then 'yaml_config' when {_EXT} = 'poml' then 'poml_config' when {_EXT} = 'md' and regexp_matches(lower(substr(content, 1, 500)), 'memory|conversation|session') then 'conversation_transcript' when {_EXT} = 'md' then 'markdown_doc' when {_EXT} = 'txt' then 'text_file' else 'unknown' end as kind from docs where source is not null",
    "conversation_files": rf"with {DOCS} select id from docs where len(list_filter(string_split(content, chr(10))[1:100], lambda x: regexp_matches(x, '(?i)^\s*(user|assistant|human|ai|system|bot)\s*:'))) >= 3",
    "chunk_strategies": f"with {DOCS}, a as (select id, content as snippet from docs) select id, case when length(snippet) < 1000 then 'full_detail' when contains(snippet, '```') or {_TECH} then 'annotation_only' else 'distilled' end as strategy from a",
    "topology_edges": rf"""with {DOCS}, p as (select id, content, coalesce(source, '') as source, coalesce(source, '') as path from docs),
 g as (select 'mem_' || md5(content || source) as from_id, list_concat(list_transform({HITS}, lambda k: '#' || k), regexp_extract_all(content, '#(\w+)'),
 [case when contains(lower(path), '/history/') or contains(lower(path), '/archive/') then '#Archive' end, case when len(h) > 0 then '#project:' || parts[h[1] + 1] end,
 case when contains(path, '/src/') or starts_with(path, 'src/') then '#src' end, case when contains(path, '/docs/') or starts_with(path, 'docs/') then '#docs' end, case when contains(path, '/tests/') or starts_with(path, 'tests/') then '#test' end,
 case when {_EXT} in ('ts','js','py','rs','go','java','cpp','c','h') then '#code' when {_EXT} in ('md','txt','rst') then '#doc' when {_EXT} in ('json','yaml','yml','xml') then '#config' end]) as tags
 from (select *, string_split(source, '/') as parts, list_filter(range(1, len(string_split(source, '/')) + 1), lambda i: list_contains(['codebase','projects','repos','src','packages','apps','personal','work','client'], lower(string_split(source, '/')[i])) and coalesce(string_split(source, '/')[i + 1], '') <> '') as h from p))
 select distinct from_id, 'atom_' || substr(sha256(tag), 1, 12) as to_id, 1.0 as weight, 'has_tag' as relation from (select from_id, unnest(tags) as tag from g) where tag is not null""",
}
SQL["sentence_offsets"] = f"select id, count(*) as n, count(*) as n_right from ({SQL['split_sentences']}) group by id"
