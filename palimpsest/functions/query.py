"""Query understanding on the driver: strings in, strings out. Tagging is a deterministic heuristic (no model)."""

from __future__ import annotations

import re
from datetime import date

# Words that carry no topic, and words that ask for what is recent.
STOP = set("a an the of and or to in on at for from with by is are was were be been it its this that these those what which who whom how why when where do does did can could should would will shall may might i you he she we they me my your our their about into over under not no if then than so as but all any some more most just please tell show give find get".split())
RECENT = ("recent", "latest", "new", "today", "now", "current", "last")


def fts(q: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^a-zA-Z0-9\s]", " ", q)).strip().lower()


def temporal(q: str, today: date) -> list[str]:
    """Years named by a query: "last N years/months/days" and explicit years of 2020 to 2029."""
    out: list[str] = []
    for n, unit in re.findall(r"last\s+(\d+)\s+(year|month|day)s?", q, re.I):
        n, unit = int(n), unit.lower()
        if unit == "year":
            out += [str(today.year - i) for i in range(n + 1)]
        elif unit == "month":
            first = today.year * 12 + today.month - 1 - n
            out += [str(y) for y in range(today.year, first // 12 - 1, -1)]
        else:
            out.append(str(today.year))
    return list(dict.fromkeys(out + re.findall(r"\b202\d\b", q)))


def keywords(q: str, today: date, keep: tuple[str, ...] = ()) -> list[str]:
    """Topic words of a query, kept words, and the years it names; all of its words if nothing is left."""
    words = fts(q).split()
    topic = [w for w in words if w not in STOP or any(w in k.lower() for k in keep)]
    return list(dict.fromkeys([*topic, *temporal(q, today)])) or words


def proper(q: str, today: date) -> list[str]:
    """Capitalised words inside the query, and the years it names."""
    caps = [w.lower() for w in re.findall(r"(?<!^)\b[A-Z][A-Za-z0-9]+", q)]
    return list(dict.fromkeys(caps + temporal(q, today)))


def strategies(q: str, today: date) -> list[list[str]]:
    """Ever looser term lists: all topic words, the longer ones, the names; empty ones are left out."""
    full = keywords(q, today)
    ladder = [full, [w for w in full if len(w) > 4 or w.isdigit()], proper(q, today)]
    return [t for i, t in enumerate(ladder) if t and t not in ladder[:i]]


def molecules(q: str, width: int = 15) -> list[str]:
    """A query in pieces: sentences, then clauses, then runs of ``width`` words."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+", q.strip()):
        for clause in re.split(r"[,;:]\s*", sentence):
            words = clause.split()
            out += [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
    return [p for p in out if p]


def parse(q: str) -> dict[str, list[str]]:
    """Phrases in quotes, @dates, #buckets, and the remaining words."""
    phrases = re.findall(r'"([^"]+)"', q)
    rest = re.sub(r'"[^"]*"', " ", q)
    return {"phrases": phrases, "temporal": re.findall(r"@(\w+)", rest), "buckets": re.findall(r"#(\w+)", rest), "keywords": re.sub(r"[@#]\w+", " ", rest).split()}


def expand(q: str, tags: list[str]) -> list[str]:
    low = q.lower()
    return [t for t in tags if t.lower() in low]


def scope(q: str, known_buckets: set[str]) -> tuple[str, list[str], list[str]]:
    """Text without #words, and the #words as buckets (known ones) or tags."""
    marks = re.findall(r"#([\w-]+)", q)
    return re.sub(r"\s+", " ", re.sub(r"#[\w-]+", " ", q)).strip(), [m for m in marks if m in known_buckets], [m for m in marks if m not in known_buckets]


def wants_recent(q: str) -> bool:
    return any(s in q.lower() for s in RECENT)


def sizes(char_budget: int) -> tuple[int, int, int]:
    """(target, anchors, walk) result counts of a character budget."""
    target = max(5, -(-(char_budget // 4) // 200))
    return target, -(-7 * target // 10), max(2, 3 * target // 10)


def legacy_k(max_chars: int, deep: bool = False) -> int:
    """Candidates of the older search: one per 500 characters, at least 30, or 200 of a deep one."""
    return max(200 if deep else 30, -(-max_chars // 500))


def entities(q: str, most: int = 3) -> list[str]:
    """The most frequent topic words of a query, first come first."""
    words = [w for w in fts(q).split() if w not in STOP]
    return sorted(dict.fromkeys(words), key=lambda w: -words.count(w))[:most]
