"""Conversations from message rows, as a fold over an event log.

Each row is an event of a message: a create, an edit or retry (a later version of the same message) or a delete. The fold
keeps the last version of each message and drops deleted ones; messages of one turn with the same role and content are one
turn. Sessions are then judged by aggregates alone, so a session that holds a third of all rows is combined map-side.

A session is kept only if no two different turns share a number, the numbers start at 0 or 1 without a gap, every speaker
is known, every content says something, and, system turns aside, the user opens and the assistant closes.

An edit may move a message to another session; the old session then no longer has it. Defined results: keys compare trimmed and in lower case; rows without a session belong nowhere; a null turn number, a
session of system turns only, and unknown or null speakers drop the session; a message without id is its own message; a
last version without a session belongs nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import norm_key, strip, write_shared

# Spellings of the three roles.
ROLES = {
    "user": ["user", "usr", "human", "me", "customer", "client", "u", "h", "q", "prompter", "you"],
    "assistant": ["assistant", "asst", "ai", "model", "bot", "chatbot", "gpt", "llm", "agent", "a", "assist"],
    "system": ["system", "sys", "developer"],
}
#: Characters that say nothing: white space, punctuation, invisible ones, ASCII signs.
NOTHING = r"\s\p{P}\p{Z}\p{C}~=|+<>^`$\x{FE00}-\x{FE0F}\x{2800}\x{3164}\x{115F}\x{1160}"
_WHAT = "response|reply|content|answer|message|output|text|data|result|completion|generation|request|call|body"
_GONE = "empty|blank|missing|deleted|removed|unavailable|not available|omitted|redacted|lost|absent"
_FAIL = "failed|failure|error|aborted|cancelled|canceled|interrupted|stopped|timed out|timeout|time out"
#: Whole contents, without brackets and in lower case, that only mark an absent or failed message.
MARKER = (
    rf"^(none|null|nil|nan|n/?a|undefined|void|no (valid |further )?({_WHAT})( (received|available|given|found|generated|yet))?|(({_WHAT})( was| is)? )?({_GONE}|{_FAIL})( ({_WHAT}))?"
    rf"|(unknown |internal |server |network )?error(: ?({_FAIL}|unknown|unknown error|no ({_WHAT}))( [0-9a-z ]*)?)?)[.!]?$"
)
_BRACKETED = r"^[\[(<{][^\[\](){}<>]{1,60}[\])>}]$"
_HINT = rf"\b(no|none|null|nil|undefined|{_GONE}|{_FAIL}|fail)\b"


def role(c: Column) -> Column:
    """user, assistant, system, or null for what is none of them."""
    word = F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    out = F.lit(None).cast("string")
    for name, spelled in ROLES.items():
        out = F.when(word.isin(spelled), name).otherwise(out)
    return out


def says_something(c: Column) -> Column:
    """Not null, not bare blanks, punctuation or invisible characters, and no marker of an absent or failed message."""
    text = F.lower(strip(c))
    inner = F.regexp_replace(text, r"^[\[(<{\"'*_\s]+|[\])>}\"'*_\s]+$", "")
    marker = inner.rlike(MARKER) | (text.rlike(_BRACKETED) & text.rlike(_HINT))
    return c.isNotNull() & c.rlike(rf"[^{NOTHING}]") & ~((F.length(text) <= 80) & marker)


def fold(events: DataFrame, session: str, message: str, version: str, turn: str, speaker: str, content: str, op: str | None = None, keep_content: bool = False) -> DataFrame:
    """Final turns (session_id, turn_num, role, says, mark[, content]). ``op``: column that is 'delete' for a delete."""
    text = strip(F.col(content))
    digest = F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"), F.length(text).alias("n"))
    state = [F.col(version).alias("version"), norm_key(F.col(session)).alias("session_id"), F.col(turn).alias("turn_num"), role(F.col(speaker)).alias("role"), F.coalesce(says_something(F.col(content)), F.lit(False)).alias("says"), digest.alias("mark")]
    if keep_content:
        state.append(text.alias("content"))
    state.append((F.lower(F.col(op)) == "delete" if op else F.lit(False)).alias("gone"))
    key = F.coalesce(F.col(message).cast("string"), F.concat_ws("\x01", F.lit("row"), norm_key(F.col(session)), F.col(turn), F.col(speaker), F.xxhash64(F.col(content))))
    last = events.select(key.alias("message"), F.struct(*state).alias("v")).groupBy("message").agg(F.max("v").alias("v")).where("v.session_id is not null and not coalesce(v.gone, false)")
    return last.select("v.session_id", "v.turn_num", "v.role", "v.says", "v.mark", *(["v.content"] if keep_content else []))


def by_turn(turns: DataFrame) -> DataFrame:
    """(session_id, turn_num, lo, hi, says[, content]): the least and the greatest version of each turn, and the least one's content."""
    what = F.struct(F.coalesce("role", F.lit("?")).alias("role"), "mark")
    content = [F.min(F.struct("role", "content")).alias("t")] if "content" in turns.columns else []
    per = turns.groupBy("session_id", "turn_num").agg(F.min(what).alias("lo"), F.max(what).alias("hi"), F.min("says").alias("says"), *content)
    return per.select("session_id", "turn_num", "lo", "hi", "says", *([F.col("t.role").alias("role"), F.col("t.content").alias("content")] if content else []))


def judge(per_turn: DataFrame) -> DataFrame:
    """(session_id, n_turns, least, reason) of ``by_turn`` rows: the least turn number; reason is null for a session to keep."""
    talk = F.when(F.col("lo.role") != "system", F.col("turn_num"))
    s = per_turn.groupBy("session_id").agg(
        F.count("*").alias("n_turns"),
        F.min("turn_num").alias("least"),
        F.max("turn_num").alias("most"),
        F.count("turn_num").alias("numbered"),
        F.bool_or(F.col("lo") != F.col("hi")).alias("shared"),
        F.bool_or((F.col("lo.role") == "?") | (F.col("hi.role") == "?")).alias("nobody"),
        F.bool_and("says").alias("says"),
        F.min_by("lo.role", talk).alias("opens"),
        F.max_by("lo.role", talk).alias("closes"),
    )
    reason = (
        F.when((F.col("numbered") < F.col("n_turns")) | ~F.col("least").isin(0, 1) | (F.col("most").cast("bigint") - F.col("least") + 1 != F.col("n_turns")), "gap")
        .when(F.col("shared"), "conflict")
        .when(F.col("nobody"), "speaker")
        .when(~F.col("says"), "empty")
        .when(F.coalesce(F.col("opens"), F.lit("")) != "user", "opening")
        .when(F.coalesce(F.col("closes"), F.lit("")) != "assistant", "unanswered")
    )
    return s.select("session_id", "n_turns", "least", reason.alias("reason"))


def conversations(turns: DataFrame) -> DataFrame:
    """Turns of the kept sessions, one row each: (session_id, position, turn_num, role, content, n_turns).

    A conversation stays a run of rows, in order within a partition, and a long one goes on in the next; it is never gathered into one value,
    as it may be of any length. The log is folded once; what is read again is the written turns."""
    per = write_shared(by_turn(turns), "turns")
    kept = judge(per).where("reason is null").select("session_id", "n_turns", "least")
    # without a gap the position follows from the number and the least number
    out = per.join(kept, "session_id").select("session_id", (F.col("turn_num") - F.col("least")).alias("position"), "turn_num", "role", "content", "n_turns")
    return out.repartitionByRange("session_id", "turn_num").sortWithinPartitions("session_id", "turn_num")
