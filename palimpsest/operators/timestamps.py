"""Mixed timestamp formats and time zones, normalised to microseconds of UTC.

Every value is parsed, once, under every format it fits, and keeps all its valid readings. Expectation-maximisation over
the format mixture of each source then decides: a value contributes likelihood under each valid reading, the posterior
picks the reading, and a value whose best posterior stays under the threshold is marked ambiguous. What is known of a
corpus beforehand enters as priors of the formats; a format whose prior is 0 keeps the posterior 0.

Defined results (``status``): ``ok`` has ``utc_us``; ``none`` denotes no single instant (null, blank, words, dates without
time, impossible values, wall times their zone skipped or ran through twice, unknown zones, values that only formats of
prior 0 can read); ``ambiguous`` has the best reading's ``utc_us`` and its posterior. Digits below microseconds are cut,
however many there are; values may be of any length. A bare number is an instant only between the bounds of ``PLAUSIBLE``,
from which its unit follows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_shared

UTC = timezone.utc
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)

# Offsets in minutes of American and European zone abbreviations.
ZONES = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540, "BRT": -180, "ART": -180,
}
# English month names.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())} | {
    m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())
} | {"sept": 9}
MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
DAY_NAME = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?)"

#: For Spark; a ``$`` would also fit before a last line end.
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]{6}[+]00:00\z"

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[ap])\.?m\.?(?![a-z]))?"
_ZONE = r"(?:\s*(?P<z>z|(?:utc|gmt)?\s*[+-]\d{2}(?::?\d{2})?|[a-z]{1,5}|[a-z]+(?:/[a-z0-9_+-]+)+)(?:\s*\[(?P<rz>[a-z0-9_+/-]+)\]|\s*\([^()]*\))?)?"
_FLAGS = re.I | re.A
_SPACES = re.compile("[\\s\u200b-\u200f\u2060\ufeff]+")
#: Date layouts; the order of day and month in each is a reading of its own.
_DATES = (
    ("iso", r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})(?:t|\s+)"),
    ("iso_slash", r"(?P<y>\d{4})/(?P<m>\d{1,2})/(?P<d>\d{1,2})(?:t|\s+)"),
    ("slash_mdy", r"(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4})(?:,)?\s+"),
    ("slash_dmy", r"(?P<d>\d{1,2})/(?P<m>\d{1,2})/(?P<y>\d{4})(?:,)?\s+"),
    ("dot_dmy", r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4})(?:,)?\s+"),
    ("dot_mdy", r"(?P<m>\d{1,2})\.(?P<d>\d{1,2})\.(?P<y>\d{4})(?:,)?\s+"),
    ("month_day", rf"(?:{DAY_NAME},?\s+)?(?P<mn>{MONTH})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}),?\s+(?:at\s+)?"),
    ("day_month", rf"(?:{DAY_NAME},?\s+)?(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s-]+(?P<mn>{MONTH})\.?,?[\s-]+(?P<y>\d{{4}}),?\s+(?:at\s+)?"),
)
_LAYOUTS = [(n, re.compile(rf"{d}{_TIME}{_ZONE}", _FLAGS)) for n, d in _DATES]
_BASIC = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})t?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?(?P<z>z|[+-]\d{2}:?\d{2})", _FLAGS)
_BASIC_T = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})t(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?", _FLAGS)
_ANSI_C = re.compile(rf"{DAY_NAME}\s+(?P<mn>{MONTH})\s+(?P<d>\d{{1,2}})\s+{_TIME}(?:\s+(?P<z>[a-z]{{1,5}}))?\s+(?P<y>\d{{4}})", _FLAGS)
_EPOCH = re.compile(r"[+-]?\d{9,19}(?:\.\d+)?", _FLAGS)
#: Plausible instants of a bare number, 1990 to before 2100: the unit follows from them.
PLAUSIBLE = (631_152_000_000_000, 4_102_444_800_000_000)


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - an unknown or malformed name is no zone
        return None


def _micros(t: datetime) -> int:
    d = t - EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def wall_to_utc(wall: datetime, zone: ZoneInfo) -> int | None:
    """Microseconds of the only instant with this wall time; None if the zone skipped it or ran through it twice."""
    a, b = (wall.replace(tzinfo=zone, fold=k).utcoffset() for k in (0, 1))
    if a != b:
        return None
    return _micros(wall.replace(tzinfo=UTC)) - _micros(EPOCH + a)


def _offset(z: str) -> int | None:
    """Minutes east of UTC of a numeric offset or an abbreviation."""
    z = z.upper().replace(" ", "")
    if z in ZONES:
        return ZONES[z]
    m = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?", z)
    if not m or int(m[2]) > 15 or int(m[3] or 0) > 59:
        return None
    return (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3] or 0))


def _read(g: dict[str, str | None], local: str) -> int | None:
    """The instant of the parts of one match; None if there is none."""
    hour = int(g["h"])
    if ap := g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if ap.lower() == "p" else 0)
    month = MONTHS[g["mn"].lower()] if g.get("mn") else int(g["m"])
    try:
        wall = datetime(int(g["y"]), month, int(g["d"]), hour, int(g["mi"]), int(g.get("s") or 0), int(((g.get("f") or "") + "000000")[:6]))
    except ValueError:
        return None
    z = g.get("z")
    try:
        if z is None:
            return wall_to_utc(wall, zone) if (zone := _zone(local)) else None
        if "/" in z:
            return wall_to_utc(wall, zone) if (zone := _zone(z)) else None
        off = _offset(z)
        return None if off is None else _micros(wall.replace(tzinfo=UTC)) - off * 60_000_000
    except (OverflowError, ValueError):
        return None


def readings(value: str | None, local: str | None) -> list[tuple[str, int]]:
    """Every valid reading of a value: (format, microseconds of UTC). ``local``: zone of values without one (null: UTC)."""
    if value is None or not (v := _SPACES.sub(" ", value).replace("\u2212", "-").strip()):
        return []
    zone, out = (local or "").strip() or "UTC", []
    if m := _BASIC.fullmatch(v) or _BASIC_T.fullmatch(v):
        return [("basic", u)] if (u := _read(m.groupdict(), zone)) is not None else []
    if _EPOCH.fullmatch(v):
        whole, _, frac = v.partition(".")
        for name, digits in (("epoch_s", 6), ("epoch_ms", 3), ("epoch_us", 0), ("epoch_ns", -3)):
            us = int(whole + (frac + "0" * 6)[:digits]) if digits > 0 else int(whole) // 10**-digits if digits else int(whole)
            if PLAUSIBLE[0] <= us < PLAUSIBLE[1]:
                out.append((name, us))
        return out
    for name, layout in (*_LAYOUTS, ("ansi_c", _ANSI_C)):
        if (m := layout.fullmatch(v)) and (us := _read(m.groupdict(), zone)) is not None:
            out.append((name, us))
    return out


#: Priors of a convention: slashed dates put the month first, dotted ones the day. Other formats have the prior 1.
US_SLASH_EU_DOT = {"slash_dmy": 0.0, "dot_mdy": 0.0}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = b.schema.names
        sets, options = [], []
        for v, z in zip(b.column(cols.index("value")).to_pylist(), b.column(cols.index("local_tz")).to_pylist()):
            r = readings(v, z)
            sets.append("|".join(n for n, _ in r))
            options.append([u for _, u in r])
        keep = [b.column(cols.index(c)) for c in ("source", "row_key")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sets, pa.string()), pa.array(options, pa.list_(pa.int64()))], names=["source", "row_key", "formats", "options"])


def mixtures(counts: list[tuple[str, str, int]], priors: dict[str, float] | None = None, rounds: int = 60, smooth: float = 0.5) -> dict[tuple[str, str], tuple[int, float]]:
    """EM over (source, set of formats, count): index of the best reading in each set, and its posterior (0: no format of the set has any share)."""
    out: dict[tuple[str, str], tuple[int, float]] = {}
    prior = lambda x: (priors or {}).get(x, 1.0)
    for source in {s for s, _, _ in counts}:
        rows = [(f.split("|"), n) for s, f, n in counts if s == source and f]
        formats = sorted({x for fs, _ in rows for x in fs})
        whole = sum(map(prior, formats))
        share = {x: prior(x) / whole if whole else 0.0 for x in formats}
        for _ in range(rounds if whole else 0):
            mass = {x: smooth * prior(x) for x in formats}
            for fs, n in rows:
                if total := sum(share[x] for x in fs):
                    for x in fs:
                        mass[x] += n * share[x] / total
            whole = sum(mass.values())
            new = {x: m / whole for x, m in mass.items()}
            moved = max(abs(math.log(new[x] / share[x])) for x in formats if share[x])
            share = new
            if moved < 1e-9:
                break
        for fs, _ in rows:
            total = sum(share[x] for x in fs)
            best = max(range(len(fs)), key=lambda i: (share[fs[i]], -i))
            out[source, "|".join(fs)] = (best, share[fs[best]] / total if total else 0.0)
    return out


PARSED = "source string, row_key string, formats string, options array<bigint>"
LEARNED = "source string, formats string, best int, posterior double"


def normalise(df: DataFrame, priors: dict[str, float] | None = None, sure: float = 0.9) -> DataFrame:
    """``df``: (source, row_key, value, local_tz). Gives (source, row_key, format, status, utc_us, posterior).

    Values are parsed once and kept in the shared folder. Only the counts of each source's sets of formats reach the driver, and
    only the sets' posteriors come back: sources are tables' fields, and sets have at most two of a dozen formats."""
    parsed = write_shared(df.select("source", "row_key", "value", "local_tz").mapInArrow(_parse, PARSED), "parsed_times")
    best = mixtures([tuple(r) for r in parsed.groupBy("source", "formats").agg(F.count("*").alias("n")).collect()], priors)
    learned = df.sparkSession.createDataFrame([(s, f, i, p) for (s, f), (i, p) in best.items()], LEARNED)
    with_pick = parsed.join(F.broadcast(learned), ["source", "formats"], "left")
    read = F.coalesce(F.col("posterior"), F.lit(0.0)) > 0
    status = F.when(~read, "none").when(F.col("posterior") < sure, "ambiguous").otherwise("ok")
    when_read = lambda c: F.when(read, c)
    return with_pick.select(
        "source", "row_key", when_read(F.get(F.split("formats", r"\|"), F.col("best"))).alias("format"), status.alias("status"), when_read(F.get("options", F.col("best"))).alias("utc_us"), when_read(F.col("posterior")).alias("posterior"),
    )
