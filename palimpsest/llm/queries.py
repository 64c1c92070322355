"""Queries of the training-data problems over the context tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, write_shared
from . import bpe, conversations, quality, spans, windows

TURNS = {"session": "session_id", "message": "id", "version": "created_at", "turn": "turn_num", "speaker": "speaker", "content": "content"}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.fold(table(spark, sf_dir, "conversation_turns"), **TURNS)
    return conversations.judge(conversations.by_turn(turns)).where("reason is not null").select("session_id")


def p2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(conversations.fold(table(spark, sf_dir, "conversation_turns"), **TURNS, keep_content=True))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, eid, text, given_high, given_emoji): one row per record with text, the latest arrival's."""
    audit = table(spark, sf_dir, "tmp_audit").select("eid", F.col("loaded_at").alias("at"), F.col("snippet").alias("text"), "non_ascii_ratio", "emoji_ratio")
    soup = table(spark, sf_dir, "token_soup_scan").select("eid", F.col("created_at").alias("at"), F.col("original_excerpt").alias("text"), F.lit(None).cast("double").alias("non_ascii_ratio"), F.lit(None).cast("double").alias("emoji_ratio"))
    both = audit.select(F.lit("tmp_audit").alias("src_table"), "*").unionByName(soup.select(F.lit("token_soup_scan").alias("src_table"), "*"))
    last = both.where(F.col("text").rlike(r"(?U)\S")).groupBy("src_table", "eid").agg(F.max(F.struct("at", "text", "non_ascii_ratio", "emoji_ratio")).alias("v"))
    return last.select("src_table", "eid", "v.text", "v.non_ascii_ratio", "v.emoji_ratio")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_texts(spark, sf_dir)).where("not is_prose").select("src_table", "eid")


def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every record with text, its type, and how far the given ratios are off."""
    v = quality.verdicts(_texts(spark, sf_dir))
    named = ("n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "ended_lines", "common_share", "triple_variety", "high_ratio", "emoji_share", "p_prose")
    shown = [F.round(c, 6).alias(c) if not c.startswith("n_") else F.col(c) for c in named]
    off = {"non_ascii_off": F.round(F.abs(F.col("non_ascii_ratio") - F.col("high_ratio")), 6), "emoji_off": F.round(F.abs(F.col("emoji_ratio") - F.col("emoji_share")), 6)}
    return v.select("src_table", "eid", *shown, "text_type", *[c.alias(k) for k, c in off.items()])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(bpe.ids_of(bpe.shipped(spark, bpe.vocabulary()), "doc_id", "text"), "doc_id bigint, ids array<int>")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(bpe.counts_of(bpe.shipped(spark, bpe.vocabulary()), "doc_id", "text"), "doc_id bigint, n_tokens bigint")


def p7_windows(spark: SparkSession, sf_dir: str, capacity: int = 2048) -> DataFrame:
    """Each document with text in its window; a document above the capacity in several."""
    counts = write_shared(_counts(spark, sf_dir), "p7_counts")
    placed = windows.pack(counts.withColumnRenamed("doc_id", "item_key"), counts.count(), capacity)
    return placed.withColumnRenamed("item_key", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the windows are."""
    w = p7_windows(spark, sf_dir).groupBy("window_id").agg(F.sum("n_tokens").alias("used"))
    return w.agg(F.count("*").alias("n_windows"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * 2048), 6).alias("fill"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_chars(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


QUERIES = {
    "p2_found": p2_found,
    "p2_conversations": p2_conversations,
    "p3_found": p3_found,
    "p3_statistics": p3_statistics,
    "p6_ids": p6_ids,
    "p7_windows": p7_windows,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
}
_BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}\x{AD}]"
_q = lambda p: "'" + p.replace("'", "''") + "'"
_ROLE = "case " + " ".join(f"when w in ({', '.join(map(_q, ws))}) then '{r}'" for r, ws in conversations.ROLES.items()) + " end"
_TALKS = rf"""
raw as (select nullif(lower(regexp_replace(session_id, '^\s+|\s+$', '', 'g')), '') as session_id, turn_num, content, regexp_replace(lower(speaker), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') as w, regexp_replace(content, '^{_BLANK}+|{_BLANK}+$', '', 'g') as t from conversation_turns),
turn as (select session_id, turn_num, {_ROLE} as role, t, content is not null and regexp_matches(content, {_q("[^" + conversations.NOTHING + "]")}) and not (length(t) <= 80 and (regexp_matches(regexp_replace(lower(t), '^[\[(<{{"''*_\s]+|[\])>}}"''*_\s]+$', '', 'g'), {_q(conversations.MARKER)})
 or (regexp_matches(lower(t), {_q(conversations._BRACKETED)}) and regexp_matches(lower(t), {_q(conversations._HINT)})))) as says from raw where session_id is not null),
one as (select distinct session_id, turn_num, role, t, coalesce(says, false) as says from turn),
num as (select session_id, turn_num, count(*) as versions, min(says) as says, count(role) = count(*) as known, min(role) as role, min(t) as t from one group by 1, 2),
ses as (select session_id, count(*) as n_turns, count(turn_num) as numbered, min(turn_num) as lo, max(turn_num) as hi, max(versions) as versions, bool_and(says) as says, bool_and(known) as known, arg_min(role, turn_num) filter (role <> 'system') as opens, arg_max(role, turn_num) filter (role <> 'system') as closes from num group by 1),
kept as (select * from ses where numbered = n_turns and lo in (0, 1) and hi - lo + 1 = n_turns and versions = 1 and says and known and opens = 'user' and closes = 'assistant')
"""
SQL = {
    "p2_found": f"with {_TALKS} select session_id from ses where session_id not in (select session_id from kept)",
    "p2_conversations": f"with {_TALKS} select session_id, turn_num - lo as position, turn_num, role, t as content, n_turns from num join kept using (session_id)",
}
