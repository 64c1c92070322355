"""Text statistics per document and a learned verdict on its type.

Statistics are counted in one Arrow pass: classes of code points for whole batches at once, and what is asked of a word once
per distinct word. Thresholds on them are noisy labelling functions: each fires or not, and speaks for one text type.
Expectation-maximisation over the counts of the fired sets learns, per type, how often each function fires, starting from
what it is meant for; the posterior of a record's set gives its text type. The driver sees only how often each set of
functions fired, at most 2**len(FUNCTIONS) rows whatever the corpus, and the sets' posteriors join back.

Function words are known for English, French, German and Spanish. A text in one script other than Latin is judged by what
prose of that script shows without them (``native``): short words among longer ones, or, where words aren't set apart, the
commonest characters of Chinese and the syllables of Japanese.

Defined results: null and blank texts have no verdict (they are left out); a text without any word is junk; statistics of
repeated rows are those of one; ratios are of code points.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_shared

TYPES = ("prose", "list", "code", "data", "junk")

# Frequent function words of English, French, German and Spanish.
COMMON = {
    "en": "the of and a to in is was it for on that with as be by at this from are were but not have has had they we you i he she or an will would can could should which when there their been if then so because until while after before into about out up no more only what how why who do did does my our your its than them these those over again just still also as against without between under",
    "fr": "le la les un une des du de et est était a à au aux en dans pour que qui ne pas sur avec ce cette ces il elle on nous vous ils se sa son ses par mais ou où si plus sans sous entre depuis jusqu tout comme ont été avait y même personne l d n s c j qu",
    "de": "der die das den dem des ein eine einen einem einer und ist war waren nicht zu in im mit auf für von vom sich es wir sie er ich auch als wie aber oder so wenn nur noch nach bei bis aus durch über unter zwischen ohne trotz wegen man hat haben wurde weil dass gab zum zur am",
    "es": "el la los las un una unos unas de del y en que es era no se por con para su sus lo al como más pero o si ya le me mi hay había fue son esta este esto ese entre sin sobre hasta desde cuando muy todo nadie todos tal creemos",
}
COMMON_WORDS = frozenset(w for words in COMMON.values() for w in words.split())
# Frequent function characters of Chinese, simplified and traditional.
COMMON_HAN = "的一是不了在有我他这個个們们來来上和也就都說说要會会沒没很到你那着把被與与及之為为以而但從从於于對对还還後后時时這"

#: Classes of code points, one bit each.
LETTER, LATIN, DIGIT, BLANK, SIGN, HIGH, EMOJI, KANA = (1 << i for i in range(8))
#: Scripts that are told apart; 0 stands for no letter or any other script, Han and Kana are one.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Hangul", "Arabic", "Hebrew", "Devanagari", "Bengali", "Tamil", "Armenian", "Georgian")
_BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CLASSES = {
    LETTER: r"\p{L}", LATIN: r"\p{Latin}", DIGIT: r"\p{Nd}", BLANK: f"[{_BLANKS}]", SIGN: r"[\[\]{}()<>=;|#_\\/^~*&$@+`]", HIGH: r"[^\x00-\x7f]",
    EMOJI: r"[\U0001f000-\U0001faff\u2600-\u27bf\u2b00-\u2bff\ufe0f]", KANA: r"[\p{Hiragana}\p{Katakana}]",
}
_SPACES = regex.compile(f"[{_BLANKS}]+")
_EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_APART = regex.compile(r"['’]+")
_NUMBER = regex.compile(r"[^a-zA-Z0-9_]*\p{Nd}[\p{Nd}.,:%/-]*(\p{L}{1,3}|%)?[^a-zA-Z0-9_]*")
_NAME = regex.compile(r"(?s)\p{L}_\p{L}|\p{Ll}\p{Lu}|\p{L}\p{Nd}|\p{Nd}\p{L}{2}|^#[a-zA-Z0-9_]|[a-zA-Z0-9_]=.")
_PLAIN = regex.compile(r"[\"'“«(¿¡>]*\p{L}[\p{L}\p{M}'’-]*[.,;:!?…\"'”»)،؛؟۔।]*")
_LINE = regex.compile(r"\r?\n|\r")
_ENDED = regex.compile(r"[.!?…:。！？؟۔।][\"'”»)\]」』]*[ \t\x0b\f]*\Z")
_MARKED = regex.compile(r"[ \t\x0b\f]*([-*•·+>|#]|\p{Nd}{1,3}[.)]|\[[ x]\])[ \t\x0b\f]*[^ \t\x0b\f]")
#: Distinct words a worker keeps at once.
WORDS = 1 << 19


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class bits, script and "frequent Han character" of every code point."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(sys.maxunicode + 1))
    bits, script, frequent = np.zeros(len(every), np.uint8), np.zeros(len(every), np.uint8), np.zeros(len(every), bool)
    for bit, pattern in _CLASSES.items():
        for m in regex.finditer(f"(?:{pattern})+", every):
            bits[m.start() : m.end()] |= bit
    bits[0xD800:0xE000] = HIGH
    for i, name in enumerate(SCRIPTS, 1):
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            script[m.start() : m.end()] = i
    script[(bits & KANA) > 0] = SCRIPTS.index("Han") + 1
    frequent[[ord(c) for c in COMMON_HAN]] = True
    return bits, script, frequent


class _Words(dict):
    """What is asked of a word, by word: (number, name, plain, short, its parts, how many of them are function words)."""

    def __missing__(self, w: str) -> tuple:
        parts = tuple(x for p in _APART.split(w.lower()) if (x := _EDGES.sub("", p)))
        plain = _PLAIN.fullmatch(w) is not None
        got = (_NUMBER.fullmatch(w) is not None, _NAME.search(w) is not None, plain, plain and len(parts) > 0 and len(parts[0]) <= 3, parts, sum(p in COMMON_WORDS for p in parts))
        if len(w) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[w] = got
        return got


@lru_cache(maxsize=1)
def _words() -> _Words:
    """One per worker process."""
    return _Words()


STATISTICS = (
    ("n_chars", "bigint"), ("n_words", "bigint"), ("n_lines", "bigint"), ("mean_word_length", "double"), ("longest_word", "bigint"), ("common_share", "double"), ("triple_variety", "double"), ("number_share", "double"), ("name_share", "double"),
    ("plain_share", "double"), ("short_share", "double"), ("single_share", "double"), ("ended_lines", "double"), ("marked_lines", "double"), ("symbol_ratio", "double"), ("digit_ratio", "double"), ("letter_ratio", "double"), ("high_ratio", "double"),
    ("emoji_share", "double"), ("foreign_share", "double"), ("native", "boolean"),
)


def statistics(texts: list[str]) -> dict[str, np.ndarray]:
    """The statistics of each text."""
    bits_of, script_of, frequent_of = _tables()
    known, n = _words(), len(texts)
    rows = np.zeros((n, 13))
    for i, t in enumerate(texts):
        ws = [w for w in _SPACES.split(t) if w] if "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t else t.split()
        asked = [known[w] for w in ws]
        parts = [p for x in asked for p in x[4]]
        k = len(parts)
        lines = [x for x in _LINE.split(t) if x.strip(" ")]
        rows[i] = (
            len(ws), len(lines), max(map(len, ws), default=0), sum(x[5] for x in asked), k, len(set(zip(parts, parts[1:], parts[2:]))) if k >= 9 else 0, sum(x[0] for x in asked), sum(x[1] for x in asked), sum(x[2] for x in asked),
            sum(x[3] for x in asked), sum(len(w) == 1 for w in ws), sum(_ENDED.search(x) is not None for x in lines), sum(_MARKED.match(x) is not None for x in lines),
        )
    n_words, n_lines, longest, common, n_parts, triples, number, name, plain, short, single, ended, marked = rows.T
    size = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.cumsum(size) - size
    full = np.flatnonzero(size)
    per_text = lambda x: np.bincount(full, weights=np.add.reduceat(x, at[full], dtype=np.int64), minlength=n) if len(full) else np.zeros(n)
    bits, script = bits_of[c], script_of[c]
    count = {b: per_text((bits & b) > 0) for b in _CLASSES}
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    letters = count[LETTER]
    most = np.zeros(n)  # letters of the commonest script that isn't Latin
    for i in range(2, len(SCRIPTS) + 1):
        if (script == i).any():
            most = np.maximum(most, per_text((script == i) & ((bits & LETTER) > 0)))
    han = per_text((script == SCRIPTS.index("Han") + 1) & ((bits & LETTER) > 0)) if (script == SCRIPTS.index("Han") + 1).any() else np.zeros(n)
    spaced = (n_words >= 4) & (share(plain, n_words) >= 0.6) & (share(short, n_words) >= 0.12) & (han * 2 < letters)
    unspaced = (han * 2 >= letters) & (letters >= 8) & ((share(per_text(frequent_of[c]), han) >= 0.08) | (share(count[KANA], han) >= 0.2))
    return {
        "n_chars": size, "n_words": n_words.astype(np.int64), "n_lines": n_lines.astype(np.int64), "mean_word_length": share(size - count[BLANK], n_words), "longest_word": longest.astype(np.int64), "common_share": share(common, n_parts),
        "triple_variety": np.where(n_parts >= 9, triples / np.maximum(1, n_parts - 2), 1.0), "number_share": share(number, n_words), "name_share": share(name, n_words), "plain_share": share(plain, n_words), "short_share": share(short, n_words),
        "single_share": share(single, n_words), "ended_lines": share(ended, n_lines), "marked_lines": share(marked, n_lines), "symbol_ratio": share(count[SIGN], size), "digit_ratio": share(count[DIGIT], size), "letter_ratio": share(letters, size),
        "high_ratio": share(count[HIGH], size), "emoji_share": share(count[EMOJI], size), "foreign_share": np.where(letters > 0, 1 - share(count[LATIN], letters), 0.0), "native": (most >= 0.85 * letters) & (letters > 0) & (spaced | unspaced),
    }


def _extended(schema: T.StructType, text: str) -> T.StructType:
    """A frame's columns without the text, and the statistics."""
    known = {n for n, _ in STATISTICS}
    out = T.StructType([f for f in schema.fields if f.name != text and f.name not in known])
    for n, kind in STATISTICS:
        out = out.add(n, {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[kind])
    return out


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the statistics' columns instead of the text (null texts count as empty)."""
    schema = _extended(df.schema, text)
    kept = [f.name for f in schema.fields if f.name not in {n for n, _ in STATISTICS}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda n: b.column(b.schema.get_field_index(n))  # noqa: B023, E731
            got = statistics([t or "" for t in col(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[col(n) for n in kept], *[pa.array(got[n]) for n, _ in STATISTICS]], names=[*kept, *[n for n, _ in STATISTICS]])

    return df.select(*kept, text).mapInArrow(run, schema)


#: Labelling functions and the type each speaks for. The first four need function words or set words; a native text has them by another sign.
SPEAK_FOR = {
    "many_common": "prose",
    "some_common": "prose",
    "plain_words": "prose",
    "sentences": "prose",
    "no_common": "list",
    "separators": "list",
    "marked": "list",
    "syntax": "code",
    "markup": "code",
    "signs": "code",
    "names": "code",
    "numbers": "data",
    "digits": "data",
    "records": "data",
    "repeats": "junk",
    "loops": "junk",
    "foreign": "junk",
    "pictures": "junk",
    "odd_words": "junk",
}
FUNCTIONS, SPEAKS = tuple(SPEAK_FOR), tuple(SPEAK_FOR.values())


def patterns(text: str = "text") -> dict[str, Column]:
    """What is searched for in a whole text: counts and marks."""
    t = F.col(text)
    return {
        "_separators": F.regexp_count(t, F.lit(r"\s[|/»·•→>-]\s|\t|;\S| {2,}\S")),
        "_items": F.regexp_count(t, F.lit(r"(^|\s)([•*-]|\p{Nd}{1,2}[.)]|#\w\S*)\s?")),
        "_syntax": t.rlike(r"(?m)(\)\s*[{:]|[;{}]\s*($|\s)|=>|[!=]==?|\+=|\breturn\b.*;|^\s*(def|const|let|var|export|import|function|class)\s+\w+|\w+\(\w*\)\s*;)"),
        "_tags": F.regexp_count(t, F.lit(r"</?[a-zA-Z][^<>]*>")),
        "_records": t.rlike(r"^\s*[\[{]\s*\"|\"\s*:\s*[\"\[{\w]|(?m)^\S{1,40}\s*[:=]\s*\S{1,24}$|\b(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\b\s*\[|\b[0-9a-f]{8}  ?([0-9a-f]{2} ){4}"),
    }


def functions() -> dict[str, Column]:
    """Name -> condition on the statistics and the patterns' columns, in the order of SPEAK_FOR."""
    c = F.col
    few, native = c("n_words") < 4, c("native")
    return {
        "many_common": (c("common_share") >= 0.22) | native,
        "some_common": (c("common_share") >= 0.12) | native,
        "plain_words": (c("plain_share") >= 0.75) | native,
        "sentences": (c("ended_lines") >= 0.5) & (native | ((c("plain_share") >= 0.5) & (c("common_share") >= 0.06) & ~few)),
        "no_common": (c("common_share") < 0.05) & (c("plain_share") >= 0.4) & ~native,
        "separators": c("_separators") >= F.greatest(F.lit(3), c("n_words") / 6),
        "marked": (c("marked_lines") >= 0.5) | (c("_items") >= F.greatest(F.lit(3), c("n_words") / 8)),
        "syntax": c("_syntax"),
        "markup": c("_tags") >= 2,
        "signs": c("symbol_ratio") >= 0.06,
        "names": c("name_share") >= 0.2,
        "numbers": c("number_share") >= 0.25,
        "digits": c("digit_ratio") >= 0.15,
        "records": c("_records"),
        "repeats": c("triple_variety") < 0.6,
        "loops": c("triple_variety") < 0.4,
        "foreign": ((c("foreign_share") >= 0.2) | (c("high_ratio") >= 0.25)) & ~native,
        "pictures": (c("emoji_share") >= 0.06) | (c("letter_ratio") < 0.35),
        "odd_words": ~native & ((c("mean_word_length") >= 13) | (c("longest_word") >= 50) | (c("single_share") >= 0.4) | few & (c("common_share") == 0)),
    }


def labelled(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the statistics and ``fired`` instead of the text: bit i is set if function i fires."""
    df = with_statistics(df.withColumns(patterns(text)), text)
    bits = F.lit(0)
    conditions = functions()
    for i, name in enumerate(FUNCTIONS):
        bits = bits + F.when(F.coalesce(conditions[name], F.lit(False)), F.lit(1 << i)).otherwise(0)
    return df.withColumn("fired", bits).drop(*patterns(text))


def learn(counts: list[tuple[int, int]], rounds: int = 200, anchor: float = 0.05) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """EM over (fired set, count): posterior of every set, and each function's rate per type.

    ``anchor``: weight of the starting rates, as a share of the records."""
    if not counts:
        return {}, np.zeros((len(TYPES), len(FUNCTIONS)))
    sets = np.array([s for s, _ in counts], np.int64)
    n = np.array([c for _, c in counts], float)
    x = (sets[:, None] >> np.arange(len(FUNCTIONS))) & 1
    own = np.array([[t == s for s in SPEAKS] for t in TYPES])
    start = np.where(own, 0.6, 0.08)
    start[1:, :4] = [0.03, 0.06, 0.15, 0.05]  # functions for prose, on other types
    start[0, :4] = [0.8, 0.95, 0.85, 0.85]
    start[0, 4:] = 0.03
    start[1, 2] = 0.4  # lists are made of plain words
    start[4, :4] = [0.45, 0.55, 0.5, 0.3]
    # nobody writes prose in loops: what speaks for junk stays rare on prose, whatever the agreements say
    most = np.where(np.array(SPEAKS) == "junk", 0.01, 0.99)
    most[[FUNCTIONS.index("repeats"), FUNCTIONS.index("loops")]] = 0.002
    start[0] = np.minimum(start[0], most)
    rate, mix = start.copy(), np.array([0.5, *[0.5 / (len(TYPES) - 1)] * (len(TYPES) - 1)])
    weight = anchor * n.sum() / len(TYPES) + 4
    post = np.zeros((len(sets), len(TYPES)))
    for _ in range(rounds):
        ll = x @ np.log(rate).T + (1 - x) @ np.log(1 - rate).T + np.log(mix)
        ll -= ll.max(1, keepdims=True)
        new = np.exp(ll)
        new /= new.sum(1, keepdims=True)
        moved = float(np.abs(new - post).max())
        post = new
        if moved < 1e-7:
            break
        mass = post * n[:, None]
        rate = (mass.T @ x + weight * start) / (mass.sum(0)[:, None] + weight)
        rate[0] = np.minimum(rate[0], most)
        mix = (mass.sum(0) + 1) / (n.sum() + len(TYPES))
    return {int(s): p for s, p in zip(sets, post)}, rate


def verdicts(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text isn't null or blank, with the statistics, ``p_prose``, ``text_type`` and ``is_prose`` instead of the text."""
    rows = labelled(df.where(F.col(text).isNotNull() & F.col(text).rlike(r"(?U)\S")), text)
    rows = write_shared(rows, "quality_rows")  # the statistics are computed once
    counts = [(r.fired, r.n) for r in rows.groupBy("fired").agg(F.count("*").alias("n")).orderBy("fired").collect()]
    post, _ = learn(counts)
    table = df.sparkSession.createDataFrame([(s, float(p[0]), TYPES[int(np.argmax(p))]) for s, p in post.items()], "fired int, p_prose double, text_type string")
    return rows.join(F.broadcast(table), "fired").withColumn("is_prose", F.col("p_prose") >= 0.5)
