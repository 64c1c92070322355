"""Queries that read whole texts and all values, on small tables of their own."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from palimpsest.operators import dedup
from palimpsest.plans import catalogue

QUERIES = catalogue.queries()
DOC = "doc_id bigint, text string, source string, lang string, bucket string, provenance string, ingested_at timestamp"


@pytest.fixture
def tables(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def documents(texts, provenance=lambda i: "internal"):
    return [(i, t, "a.md", "en", "x", provenance(i), datetime(2025, 1, 1)) for i, t in texts]


def test_whole_summaries_are_linked(spark, tables):
    rng = random.Random(9)
    say = lambda ws, n: " ".join(rng.choice(ws) for _ in range(n))
    heads, tails = ([f"{x}word{i}" for i in range(40)] for x in "ab")
    # heads of 400 characters have other words than any original; the likeness lies behind them
    texts = [(i, say(heads, 60) + " " + say(tails[5 * i :], 60)) for i in range(6)] + [(100 + i, say(tails[2 * i :], rng.randint(50, 150))) for i in range(12)]
    kind = lambda i: "external" if i < 100 else "internal"
    got = {r.s_id: (r.o_id, r.score) for r in QUERIES["jaccard_link"](spark, tables("documents", documents(texts, kind), DOC)).collect()}
    want = {}
    for i, t in texts[:6]:
        n = -(-len(t) // 4)
        best = max(((round(len(set(t.split()) & set(u.split())) / len(set(t.split()) | set(u.split())), 6), -k) for k, u in texts[6:] if max(200, 2 * n) <= len(u) <= int(6.4 * n)), default=(0, 0))
        if best[0] >= 0.18:
            want[i] = (-best[1], best[0])
    assert len(want) > 2 and got == want


def test_fallback_hash_is_of_the_whole_content(spark, tables):
    def hashed(text):
        h, raw = 0, text.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[i : i + 2], "little")) % 2**32
        return format(h - 2**32 if h >= 2**31 else h, "x")

    head = "the same head " * 20
    texts = [(1, head + "one"), (2, head + "two"), (3, "polygenelubricants"), (4, "a\U0001f642é"), (5, ""), (6, head * 400 + "x"), (7, "hello world, a negative one")]
    got = {r.id: r.fallback for r in QUERIES["uuid_app_ids"](spark, tables("documents", documents(texts), DOC)).collect()}
    assert got == {i: hashed(t) for i, t in texts}
    assert got[1] != got[2] and got[5] == "0" and got[3] == "-80000000"


FORMS = {
    "1736544808": "2025-01-10 21:33:28", "1736344860234": "2025-01-08 14:01:00.234", "1737444699.050409": "2025-01-21 07:31:39.050409", "2025-01-04T19:18:33.661619067Z": "2025-01-04 19:18:33.661619", "2025-01-06T20:54:03.723683": "2025-01-06 20:54:03.723683",
    "2025-01-15": "2025-01-15", "2025-01-17t00:26:54z": "2025-01-17 00:26:54", "20250108T190627Z": "2025-01-08 19:06:27", "2025-01-21 10:58:56,280+00:00": "2025-01-21 10:58:56.280", "01.02.2026 15:14": "2026-02-01 15:14",
    "2025-01-07 22:17:18 Australia/Sydney": "2025-01-07 11:17:18", "2025-01-08 06:50:53 EST": "2025-01-08 11:50:53", "2025-07-28 03:38:59 MDT": "2025-07-28 09:38:59", "Apr 3, 2025 08:45 AM": "2025-04-03 08:45", "2025-01-21T06:55:03-0500": "2025-01-21 11:55:03",
    "Fri, 06 Feb 2026 00:53:14 -0800": "2026-02-06 08:53:14", "Fri Apr 04 2025 20:56:35 GMT-0600 (Mountain Daylight Time)": "2025-04-05 02:56:35", "10 August 2025, 03:23:05 MDT": "2025-08-10 09:23:05", "11 October 2025, 12:13:17 MST": "2025-10-11 19:13:17",
    "2025-02-01T10:21:27+01:00[Europe/Berlin]": "2025-02-01 09:21:27", "1/17/2026 7:09:47 AM": "2026-01-17 07:09:47", " 2025-01-23T15:36:21.670080+00:00\t": "2025-01-23 15:36:21.670080", "0000-00-00 00:00:00": None, "N/A": None, "": None, "2025-04-??": None, "Invalid Date": None,
}


def test_all_forms_of_both_fields_are_read(spark, tables):
    forms = list(FORMS)
    rows = [(str(i), v, forms[-1 - i]) for i, v in enumerate(forms)] + [("null", None, None)]
    got = {(r.repair_id, r.field): r.us for r in QUERIES["flexible_timestamps"](spark, tables("repair_canary_run2", rows, "repair_id string, s_created_at string, orig_created_at string")).collect()}
    us = lambda t: None if t is None else (datetime.fromisoformat(t) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert got == {(i, f): us(FORMS[v]) for i, a, b in rows for f, v in (("s_created_at", a), ("orig_created_at", b)) if v is not None}


def test_whole_contents_are_cleaned(spark, tables):
    texts = [(1, "Say: 'NEAR'(x)* " * 50 + "AND\n\tend!"), (2, "short?"), (3, "")]
    got = {r.id: r.q for r in QUERIES["fts_query_clean"](spark, tables("documents", documents(texts), DOC)).collect()}
    assert got == {1: "say near x " * 50 + "and end", 2: "short", 3: ""}


def greedy(prints):
    kept = []
    for i, h in sorted(prints):
        if not h or not any(g and ((h ^ g) & (2**64 - 1)).bit_count() < 3 for _, g in kept):
            kept.append((i, h))
    return sorted(i for i, _ in kept)


def test_suppression_over_a_whole_table(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(63) - rng.getrandbits(62) for _ in range(12)]
    prints = [(i, rng.choice(values) ^ (1 << rng.randrange(6)) ^ (1 << rng.randrange(6))) for i in range(300)]
    prints += [(400 + i, (1 << (2 * i)) - 1) for i in range(1, 20)]  # a chain: each is two bits from the next
    prints += [(500, 0), (501, 0), (502, None)]
    rng.shuffle(prints)
    got = sorted(r.id for r in dedup.suppress_all(spark.createDataFrame(prints, "id bigint, simhash bigint")).collect())
    assert got == greedy(prints) and 30 < len(got) < 200


def test_near_copies_of_any_document_are_suppressed(spark, tables):
    say = lambda seed: " ".join(random.Random(seed).choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(60))
    texts = [(1, say(1)), (2, say(2)), (3, say(1)), (4, say(2)), (5, say(5)), (6, "")]
    assert sorted(r.id for r in QUERIES["near_dup_suppressed"](spark, tables("documents", documents(texts), DOC)).collect()) == [1, 2, 5, 6]


def test_a_line_end_is_not_canonical(spark, tables):
    canonical = "2025-01-16T13:22:37.880182+00:00"
    tables("conversation_turns", [(9, None, None)], "id bigint, timestamp string, client_tz string")
    d = tables("repair_canary_run2", [("a", canonical, None), ("b", canonical + "\n", canonical + "\r\n")], "repair_id string, s_created_at string, orig_created_at string")
    got = sorted((r.src_field, r.row_key, r.utc_us) for r in QUERIES["p4_found"](spark, d).collect())
    assert got == [("orig_created_at", "b", 1737033757880182), ("s_created_at", "b", 1737033757880182)]
