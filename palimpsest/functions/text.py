"""Text kernels as Spark expressions. All take and give Columns; null stays null unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that the cleaning steps remove, in order, and what takes their place.
NOISE = (
    (r"^\x{FEFF}", ""),
    (r"[\x{0}\x{FFFD}]", ""),
    (r"\r\n", "\n"),
    (r"(?:^|\s|\.{3}\s*)(?:Processing|Loading|Indexing|Analyzing) '[^']+'\.{3}", "\n"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{3})?\s*(?:AM|PM)?\s*[-:>]", ""),
    (r"\[\d{4}-\d{2}-\d{2}.*?\]", ""),
    (r"\[[#=]{0,10}\s{0,10}\]\s*\d{1,3}%", ""),
    (r"\n{3,}", "\n\n"),
)
# Personal data and its masks.
PERSONAL = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_REDACTED]"),
    (r"sk-[a-zA-Z0-9]{32,}", "sk-[REDACTED]"),
)
# Keys of JSON wrappers, by preference.
JSON_FIELDS = ("content", "response_content", "message", "text", "body", "data")
# File extensions, project folders, month names, words and patterns of quality tests.
CODE_EXT = ("ts", "js", "py", "rs", "go", "java", "cpp", "c", "h")
DOC_EXT = ("md", "txt", "rst")
CONFIG_EXT = ("json", "yaml", "yml", "xml")
PROJECT_DIRS = ("codebase", "projects", "repos", "src", "packages", "apps", "personal", "work", "client")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
SPAM = ("erotik", "click here", "buy now", "free", "cheap", "subscribe now", "http://", "https://")
TECHNICAL = ("error", "exception", "traceback", "sudo", "apt-get", "npm", "pip", "docker", "cargo", "journal", "systemd", "kernel", "trace", "failed", "stacktrace")
JSON_LIKE = r"\{\s*\".*\"\s*:\s*|\[\s*\{|\"response_content\"|\"timestamp\""
HTML_LIKE = r"<\s*/?\w+[^>]*>|<a\s+href=|<script\b|<div\b|<p\b"
EMOJI = r"[\x{1F300}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]"
WINDOWS_PATH = r"[A-Za-z]:[\\/](?:[\w\-.@ ]+[\\/])+[\w\-.@ ]+"
UNIX_PATH = r"/(?:[\w\-.@]+/)+[\w\-.@]+"
HEX_DUMP = r"(?:0x[0-9a-fA-F]{2,}|[0-9A-Fa-f]{2,}(?:\s+[0-9A-Fa-f]{2,}){4,})"


def _chain(c: Column, steps: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


# --- cleaning ---------------------------------------------------------------------------------


def mask_personal(c: Column) -> Column:
    """Mail addresses, IPv4 addresses and secret keys masked."""
    return _chain(c, PERSONAL)


def json_content(c: Column) -> Column:
    """Texts of the flat JSON objects in a text, joined by blank lines; null if there are none."""
    objects = F.regexp_extract_all(c, F.lit(r"(\{[\s\S]*?\})"), F.lit(1))
    # only strings count; the objects are flat, so a key stands before its own value
    first = lambda o: F.coalesce(*[F.when(o.rlike(rf'"{k}"\s*:\s*"'), F.nullif(F.get_json_object(o, f"$.{k}"), F.lit(""))) for k in JSON_FIELDS])
    texts = F.array_compact(F.transform(objects, first))
    return F.when(F.size(texts) > 0, F.concat(F.array_join(texts, "\n\n"), F.lit("\n\n")))


def is_json_log(c: Column, path: Column) -> Column:
    marked = any_of(*[c.contains(k) for k in ('"response_content":', '"thinking_content":', '"message":', '"content":')])
    return path.endswith(".json") | (~extension(path).isin(*CODE_EXT) & marked)


def sanitize(c: Column, path: Column) -> Column:
    """The cleaning pipeline: noise, personal data, JSON wrappers, outer white space; in one pass over each Arrow batch."""
    from .kernels import sanitize as kernel

    return kernel(c, path)


# --- types, numbers, tags -----------------------------------------------------------------------


def molecule_type(c: Column, path: Column) -> Column:
    """data, code or prose of a fragment. A word boundary keeps "functional" from counting as code."""
    ext = extension(path)
    code = c.contains("```") | c.rlike(r"\b(function|const|import) ")
    return F.when(ext.isin("csv", "json"), "data").when(ext.isin(*CODE_EXT), "code").when(F.ltrim(c).startswith("|"), "data").when(code, "code").otherwise("prose")


def numbers(c: Column) -> Column:
    """ARRAY<STRUCT<value, unit>> of the numbers of a text; bare whole numbers that look like years are left out."""
    value = F.transform(F.regexp_extract_all(c, F.lit(r"([\d,]+\.?\d*)\s?([A-Za-z%]+)?"), F.lit(1)), lambda v: F.regexp_replace(v, ",", "").try_cast("double"))
    unit = F.transform(F.regexp_extract_all(c, F.lit(r"([\d,]+\.?\d*)\s?([A-Za-z%]+)?"), F.lit(2)), lambda u: F.nullif(u, F.lit("")))
    pair = F.zip_with(value, unit, lambda v, u: F.struct(v.alias("value"), u.alias("unit")))
    year = lambda x: x.unit.isNull() & x.value.between(1900, 2100) & (x.value == F.floor(x.value))
    return F.filter(pair, lambda x: x.value.isNotNull() & ~F.coalesce(year(x), F.lit(False)))


def numeric(c: Column) -> Column:
    """STRUCT<value, unit>: the last number with a unit, else the first number; null if there is none."""
    ns = numbers(c)
    with_unit = F.filter(ns, lambda x: x.unit.isNotNull())
    return F.when(F.size(with_unit) > 0, F.element_at(with_unit, -1)).otherwise(F.get(ns, F.lit(0)))


def hashtags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"#(\w+)"), F.lit(0)))


def keyword_hits(c: Column, keywords: Sequence[str]) -> Column:
    """Keywords that the text contains anywhere, whatever the case, in the list's order."""
    low = F.lower(c)  # one expression per keyword: compiled, and the lower case is taken once
    return F.array_compact(F.array(*[F.when(low.contains(k.lower()), F.lit(k)) for k in keywords]).cast("array<string>"))


def scan_tags(c: Column, keywords: Sequence[str]) -> Column:
    return F.array_distinct(F.concat(F.transform(keyword_hits(c, keywords), lambda k: F.concat(F.lit("#"), k)), hashtags(c)))


def years(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)))


def infect(tags: Column, c: Column, keywords: Sequence[str]) -> Column:
    """Tags with the text's keywords, years and month names added."""
    low = F.lower(c)
    months = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{m.lower()}\b"), F.lit(m)) for m in MONTHS]))
    return F.array_union(F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.concat(keyword_hits(c, keywords), years(c))), months)


def system_tags(path: Column) -> Column:
    """Tags that follow from a path: archive, project, structure, file type."""
    p = F.regexp_replace(path, r"\\", "/")
    low, ext, parts = F.lower(p), extension(p), F.split(p, "/")
    at = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.lower(F.element_at(parts, i)).isin(*PROJECT_DIRS) & (F.coalesce(F.get(parts, i), F.lit("")) != ""))
    project = F.when(F.size(at) > 0, F.concat(F.lit("#project:"), F.get(parts, F.get(at, F.lit(0)))))
    under = lambda d: p.contains(f"/{d}/") | p.startswith(f"{d}/")
    return F.array_compact(
        F.array(
            F.when(low.contains("/history/") | low.contains("/archive/"), "#Archive"),
            project,
            F.when(under("src"), "#src"),
            F.when(under("docs"), "#docs"),
            F.when(under("tests"), "#test"),
            F.when(ext.isin(*CODE_EXT), "#code").when(ext.isin(*DOC_EXT), "#doc").when(ext.isin(*CONFIG_EXT), "#config"),
        )
    )


def display_tags(tags: Column) -> Column:
    """Tags without bare years."""
    return F.filter(tags, lambda t: ~t.rlike(r"^\d{4}$"))


def path_bucket(path: Column) -> Column:
    """Bucket of a watched file: the folder below the inbox, else the first folder, else ``notebook``."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return F.when(F.size(parts) < 2, "notebook").when((F.get(parts, F.lit(0)).isin("inbox", "external-inbox")) & (F.size(parts) > 2), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))


def watch_provenance(path: Column) -> Column:
    return F.when(path.contains("inbox") & ~path.contains("external-inbox"), "internal").otherwise("external")


def provenance(source: Column, kind: Column) -> Column:
    """Trust class of pushed content, by source folder and type; the own inbox goes before everything, the rest is external."""
    s = F.regexp_replace(F.coalesce(source, F.lit("")), r"\\\\", "/")
    own = s.rlike(r"(^|/)(internal-)?inbox/") | (F.coalesce(kind, F.lit("")) == "user")
    return F.when(own, "internal").otherwise("external")


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def word_token_estimate(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+")) + F.ceil(F.length(c) / 4)


def fts_query(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9\s]", " "), r"\s+", " ")))


# --- quality -------------------------------------------------------------------------------------


def json_like(c: Column) -> Column:
    return F.coalesce(c.rlike(JSON_LIKE), F.lit(False))


def html_like(c: Column) -> Column:
    return F.coalesce(c.rlike(HTML_LIKE), F.lit(False))


def technical_signal(c: Column) -> Column:
    low = F.lower(c)
    words = any_of(*[low.contains(k) for k in TECHNICAL])
    return F.coalesce(words | c.rlike(r"v\d+\.\d+(?:\.\d+)?|/\w+/\w+|[A-Za-z]:\\\\|[\p{L}\p{N}_][$#] "), F.lit(False))


def non_ascii_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[\x{00}-\x{7F}]", "")) / F.length(c)).otherwise(0.0)


def emoji_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(EMOJI)) / F.length(c)).otherwise(0.0)


def spam_hits(c: Column) -> Column:
    low = F.lower(c)
    return F.concat_ws(",", *[F.when(low.contains(k), F.lit(k)) for k in SPAM])


def suspect(c: Column) -> Column:
    return ((json_like(c) | html_like(c)) & ~technical_signal(c)) | (F.round(non_ascii_ratio(c), 4) > 0.3) | (F.round(emoji_ratio(c), 4) > 0.05) | (F.coalesce(spam_hits(c), F.lit("")) != "")


def token_soup(c: Column) -> Column:
    """Whether a text looks garbled, from shares of odd tokens; texts under 40 characters never do."""
    s = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    ts = F.filter(F.split(s, r"\s+"), lambda t: t != "")
    n = F.size(ts)
    share = lambda cond: F.size(F.filter(ts, cond)) / n
    code = share(lambda t: t.rlike(r"[(){}\[\]<>;=:\\|/@#%$]"))
    hexes = (
        F.size(F.filter(ts, lambda t: t.rlike(r"^(0x[0-9a-fA-F]{8,}|[A-Fa-f0-9]{16,})$"))) + F.size(F.filter(ts, lambda t: t.rlike("[0-9]") & ~t.rlike("[A-Za-z]") & (F.length(t) >= 8)))
    ) / n
    single = share(lambda t: F.length(t) == 1)
    no_vowel = share(lambda t: (F.length(t) >= 6) & ~t.rlike("[aeiouAEIOU]"))
    alpha = share(lambda t: t.rlike("^[A-Za-z]+$"))
    lengthy = share(lambda t: F.length(t) > 30)
    odd = (code > 0.25) | (hexes > 0.05) | (single > 0.25) | ((alpha < 0.25) & ((no_vowel > 0.2) | (lengthy > 0.05))) | s.rlike(r"[^\w\s]{6,}")
    return F.coalesce((F.length(s) >= 40) & (n >= 3) & odd, F.lit(False))


def strip_soup(c: Column) -> Column:
    """Readable rest of a garbled text, at most 500 characters."""
    # What is taken out, in order.
    t = _chain(
        c,
        [(r"(?s)```.*?```", " "), (r"\b[A-Za-z_][A-Za-z0-9_]*\([^)]*\)", " "), (r"0x[0-9a-fA-F]{6,}", " "), (r"\b[A-Fa-f0-9]{16,}\b", " "), (r"[<>|\\]+", " "), (r"(?U)[^\w\s.,;:\-'\"()]+", " "), (r"(?U)\s+", " ")],
    )
    t = F.trim(t)
    return F.when(F.length(t) > 500, F.concat(F.substring(t, 1, 500), F.lit("..."))).otherwise(t)


def shortened(c: Column, pattern: str, longest: int, keep: int) -> Column:
    """Every match of more than ``longest`` characters cut to ``keep`` and dots."""
    between, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    cut = F.transform(found, lambda m: F.when(F.length(m) > longest, F.concat(F.substring(m, 1, keep), F.lit("..."))).otherwise(m))
    return F.when(F.exists(found, lambda m: F.length(m) > longest), F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(cut, i), F.lit("")))), "")).otherwise(c)


def normalize_technical(c: Column) -> Column:
    """Terminal codes, hex dumps and markup taken out, and named in sorted notes in front."""
    ansi, windows, unix, dump, html = c.rlike(r"\x1b\[[0-9;]*[A-Za-z]"), c.rlike(r"[A-Za-z]:[\\/]"), c.rlike(r"/usr/|/bin/|/home/") | c.rlike(UNIX_PATH), c.rlike(HEX_DUMP), html_like(c)
    notes = F.array_compact(F.array(F.when(dump, "[Binary Data Omitted]"), F.when(html, "[Context: HTML]"), F.when(ansi, "[Context: Terminal Output]"), F.when(unix, "[OS: Linux]"), F.when(windows, "[OS: Windows]")))
    t = F.regexp_replace(c, r"\x1b\[[0-9;]*[A-Za-z]", " ")
    t = F.when(windows, shortened(t, WINDOWS_PATH, 70, 60)).otherwise(t)
    t = F.when(unix, shortened(t, UNIX_PATH, 80, 80)).otherwise(t)
    t = F.regexp_replace(t, HEX_DUMP, "[binary_data]")
    t = F.when(html, F.regexp_replace(t, r"<[^>]+>", " ")).otherwise(t)
    t = F.trim(_chain(t, [(r"[\x{00}\x07\x0b\x0c]", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;", "'"), (r"&amp;", "&"), (r"(?U)\s+", " ")]))
    return F.when(F.size(notes) > 0, F.concat(F.array_join(notes, " "), F.lit(" "), t)).otherwise(t)


def clean_content(c: Column) -> Column:
    """JSON text taken out, tags, entities and emoji removed, odd characters and white space collapsed; null becomes empty."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    fields = F.coalesce(*[F.nullif(F.get_json_object(t, f"$.{k}"), F.lit("")) for k in ("response_content", "content", "text", "message", "response")])
    t = F.when(t.rlike(r"^[{\[]") | t.contains('"response_content"'), F.coalesce(fields, t)).otherwise(t)
    t = _chain(t, [(r"<[^>]+>", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;", "'"), (r"&nbsp;", " "), (r"&amp;", "&"), (EMOJI, ""), (r"(?U)[^\w\s.,;:\-'\"@#%()?/\\]+", " "), (r"(?U)\s+", " ")])
    return F.coalesce(F.trim(t), F.lit(""))


# --- entities, dates, small rules ----------------------------------------------------------------


def entities(c: Column, most: int = 10) -> Column:
    """Versions, paths and package names of technical texts, then runs of capitalised words; distinct whatever the case."""
    grab = lambda p, g=0: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    technical = F.when(technical_signal(c), F.concat(grab(r"v?\d+\.\d+(?:\.\d+)?"), grab(r"(?:/[\w.-]+){2,}"), grab(r"\b[a-z][a-z0-9]+(?:-[a-z0-9]+)+\b"))).otherwise(F.array().cast("array<string>"))
    found = F.concat(technical, grab(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"))
    full = lambda acc, x: (F.size(acc) >= most) | F.exists(acc, lambda y: F.lower(y) == F.lower(x))
    return F.aggregate(found, F.array().cast("array<string>"), lambda acc, x: F.when(full(acc, x), acc).otherwise(F.array_append(acc, x)))


def content_date(c: Column) -> Column:
    """First date of the first 2,000 characters: ISO, then month/day/year, then month name; null if impossible or absent."""
    head = F.substring(c, 1, 2000)
    iso = F.regexp_extract(head, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    us = F.regexp_extract(head, r"\b(\d{1,2}/\d{1,2}/\d{4})\b", 1)
    name = F.regexp_extract(head, r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? \d{1,2},? \d{4})\b", 1)
    short = F.concat_ws(" ", F.substring(name, 1, 3), F.regexp_extract(name, r"(\d{1,2}),? (\d{4})$", 1), F.regexp_extract(name, r"(\d{4})$", 1))
    to = lambda x, f: F.try_to_timestamp(F.nullif(x, F.lit("")), F.lit(f)).cast("date")
    return F.when(iso != "", to(iso, "yyyy-MM-dd")).when(us != "", to(us, "M/d/yyyy")).when(name != "", to(short, "MMM d yyyy"))


# Offsets of American and European zone abbreviations.
_ABBREVIATED = {
    "UTC": "+00:00", "GMT": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00",
    "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}
#: Rewritings of a time as text towards ISO, in order: notes after the zone, the day's name, basic form, small t and z, comma, offsets.
_TOWARDS_ISO = (
    (r"\s*(\[[^\]]*\]|\([^)]*\))$", ""), (r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""), (r"(?i)^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6"),
    (r"^(\d{4}-\d{2}-\d{2})t", "$1T"), (r"(\d)z$", "$1Z"), (r"(:\d{2}),(\d+)", "$1.$2"), (r"(:\d{2}(?:\.\d+)?\s*)(?:GMT|UTC)?([+-]\d{2}):?(\d{2})$", "$1$2:$3"),
)
_FREE_FORMS = ("MMM d, yyyy hh:mm a", "M/d/yyyy h:mm:ss a", "dd.MM.yyyy HH:mm", "d MMMM yyyy, HH:mm:ss XXX", "d MMMM yyyy, HH:mm:ss z", "d MMM yyyy HH:mm:ss XXX", "MMM d yyyy HH:mm:ss XXX")


def flexible_timestamp(c: Column) -> Column:
    """Epoch seconds or milliseconds, whole or with a fraction, ISO, or free date and time."""
    n = F.when(c.rlike(r"^\d{9,14}(\.\d{1,12})?$"), c).try_cast("decimal(28,12)")
    epoch = F.timestamp_micros(F.floor(n * F.when(n >= 100_000_000_000, 1000).otherwise(1_000_000)).cast("bigint"))
    t = c
    for old, new in _TOWARDS_ISO:
        t = F.regexp_replace(t, old, new)
    offsets = F.create_map(*[F.lit(x) for kv in _ABBREVIATED.items() for x in kv])

    def zoned(x: Column) -> Column:
        return F.coalesce(F.concat(F.regexp_replace(x, r"[A-Z]+$", ""), offsets[F.regexp_extract(x, r":\d{2}(?:\.\d+)? ([A-Z]{3,4})$", 1)]), x)

    def read(x: Column) -> Column:
        return F.coalesce(F.try_to_timestamp(x), *[F.try_to_timestamp(x, F.lit(f)) for f in _FREE_FORMS])

    # as elements of an array each step is one value, not an expression that the next step repeats
    return F.coalesce(epoch, F.when(n.isNull(), F.get(F.transform(F.transform(F.array(t), zoned), read), F.lit(0))))


def temporal_tags(ts: Column) -> Column:
    """Year, month, weekday, season, quarter and time of day of an instant, in UTC."""
    month, hour = F.month(ts), F.hour(ts)
    season = F.when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").when(month.isin(9, 10, 11), "Autumn").otherwise("Winter")
    part = F.when(hour.between(5, 11), "Morning").when(hour.between(12, 16), "Afternoon").when(hour.between(17, 20), "Evening").otherwise("Night")
    return F.array(F.year(ts).cast("string"), F.date_format(ts, "MMMM"), F.date_format(ts, "EEEE"), season, F.concat(F.lit("Q"), F.quarter(ts)), part)


def file_class(path: Column, content: Column) -> Column:
    """Kind of a file by its extension; Markdown that speaks of talks in its first 500 characters is a transcript."""
    head, ext = F.lower(F.substring(content, 1, 500)), extension(path)
    talk = head.rlike("memory|conversation|session")
    return F.when(ext.isin("yaml", "yml"), "yaml_config").when(ext == "poml", "poml_config").when((ext == "md") & talk, "conversation_transcript").when(ext == "md", "markdown_doc").when(ext == "txt", "text_file").otherwise("unknown")


def is_conversation(c: Column) -> Column:
    """At least three of the first hundred lines open with a role."""
    lines = F.slice(F.split(c, "\n"), 1, 100)
    return F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(r"(?i)^\s*(user|assistant|human|ai|system|bot)\s*:"))) >= 3, F.lit(False))


def first_sentences(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(c), r"(?<=[.!?])\s+"), 1, n), " ")


def chunk_strategy(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 1000, "full_detail").when(c.contains("```") | technical_signal(c), "annotation_only").otherwise("distilled")


def evidence_weight(kind: Column, source: Column) -> Column:
    """Weight of a supporting record: code and logs, then documents, then talk."""
    return F.when((kind == "code") | source.rlike(r"\.(py|log)$"), 1.0).when((kind == "doc") | source.endswith(".md"), 0.8).when(kind == "chat", 0.4).otherwise(0.5)


def provenance_score(kind: Column, source: Column, source_type: Column) -> Column:
    """Trust at write time: by category, else by the source's extension, else by its type."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    by_kind = F.when(k == "code", 1.0).when(k.isin("log", "logs"), 0.95).when(k.isin("doc", "docs", "documentation"), 0.8).when(k.isin("chat", "conversation", "message"), 0.4)
    by_source = F.when(source.rlike(r"\.(py|js)$"), 1.0).when(source.endswith(".log"), 0.95).when(source_type == "doc", 0.8)
    return F.coalesce(by_kind, by_source, F.lit(0.5))


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^a-zA-Z0-9\-_]", "_"), 1, 64)
