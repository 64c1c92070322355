from __future__ import annotations

import hashlib
import re
import uuid

import pytest

from palimpsest.functions import kernels as K
from palimpsest.plans import catalogue

from .compare import connect, same

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, SQL[name])


def _texts(con):
    return dict(con.execute("select doc_id, text from documents where text is not null").fetchall())


def _pieces(rows, con):
    texts = _texts(con)
    assert rows and all(texts[r.id][r.start : r.end] == r.content for r in rows)
    assert {r.id for r in rows} <= set(texts) and len({(r.id, r.sequence) for r in rows}) == len(rows)


def _chunked(join, whole=True):
    def check(rows, con):
        parts: dict = {}
        for r in sorted(rows, key=lambda r: (r.id, r.sequence)):
            parts.setdefault(r.id, []).append(r.chunk)
        texts = {k: t for k, t in _texts(con).items() if t}
        assert set(parts) == set(texts)
        assert all((join(parts[k]) == t) if whole else (t.startswith(parts[k][0]) and t.endswith(parts[k][-1]) and all(x in t for x in parts[k])) for k, t in texts.items())

    return check


def _cleaned(rows, con):
    paths = dict(con.execute("select doc_id, source from documents").fetchall())
    texts = _texts(con)
    assert {r.id: r.clean for r in rows} == {k: K.sanitized(t, paths[k]) for k, t in texts.items()}
    assert not [r for r in rows if re.search(r"[a-z0-9]@[a-z0-9-]+[.][a-z]{2}", r.clean) and "{" not in texts[r.id]]


def _app_ids(rows, con):
    assert {r.id: (r.app_id, r.fallback) for r in rows} == {k: (str(uuid.uuid5(uuid.NAMESPACE_URL, t[:4096])), K.rolling31(t)) for k, t in _texts(con).items()}


def _kept(rows, con):
    kept, prints = [], {k: K.simhash_of(t) for k, t in _texts(con).items()}
    for k in sorted(prints):
        if not prints[k] or not any(prints[g] and ((prints[k] ^ prints[g]) & (2**64 - 1)).bit_count() < 3 for g in kept):
            kept.append(k)
    assert sorted(r.id for r in rows) == kept


def _windows(rows, con):
    texts = _texts(con)
    hits = {k: [(m.start(), m.end()) for m in re.finditer("retry queue|pump schedule", t, re.I)] for k, t in texts.items()}
    got: dict = {}
    for r in rows:
        assert texts[r.id][r.start : r.end] == r.snippet
        got.setdefault(r.id, []).append((r.start, r.end))
    assert set(got) == {k for k, h in hits.items() if h}
    assert all(any(a <= s and e <= b for a, b in got[k]) for k in got for s, e in hits[k])


def _molecules(rows, con):
    texts = _texts(con)
    assert rows and {r.compound_id for r in rows} <= {"mem_" + hashlib.md5((t + (s or "")).encode()).hexdigest() for t, s in con.execute("select text, source from documents where text is not null").fetchall()}
    assert all(0 <= r.start < r.end <= max(map(len, texts.values())) for r in rows) and {r.type for r in rows} <= {"prose", "code", "data"}


def _executed(rows, con):
    before = {(r[0], r[1]): r[3] for r in con.execute(SQL["searched_scored"]).fetchall()}
    assert rows and all(abs(before[r.query_id, r.id] - r.score) < 1e-3 for r in rows) and len(rows) <= len(before)


def _packed(rows, con):
    by: dict = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    assert by and all(sum(r.n_chars for r in rs) <= 2000 * 4 and sorted(r.position for r in rs) == list(range(1, len(rs) + 1)) for rs in by.values())


def _times(rows, con):
    n = con.execute("select count(*) from (select distinct repair_id, s_created_at from repair_canary_run2 where s_created_at is not null union all select distinct repair_id, orig_created_at from repair_canary_run2 where orig_created_at is not null)").fetchone()[0]
    assert len(rows) <= n and sum(r.us is not None for r in rows) > 0.8 * len(rows)


def _records(rows, con):
    assert {r.id: r.n_chars for r in rows} == dict(con.execute("select cast(repair_id as varchar), min(length(s_excerpt)) from repair_canary_run2 group by 1").fetchall())


def _sessions(rows, con):
    whole = {(r[0], r[1]): r[3:] for r in con.execute(SQL["session_windows"]).fetchall()}
    assert rows and all(whole[r.user_id, r.first_us][0] == r.n for r in rows)


def _status(rows, con):
    assert {r.status for r in rows} <= {"ok", "none", "ambiguous"} and sum(r.n for r in rows if r.status == "ok") > 0
    assert all(r.least_posterior is None if r.status == "none" else 0 < r.least_posterior <= 1 for r in rows)


def _unsure(rows, con):
    found = {(r[0], r[1], r[2]) for r in con.execute(SQL["p4_found"]).fetchall()}
    assert all(r.posterior < 0.9 and (r.src_table, r.src_field, r.row_key) in found or r.format.startswith(("slash", "dot")) for r in rows)


def _markdown(rows, con):
    assert len(rows) == len(_texts(con)) and all(r.markdown.startswith("# Head") and "menu" not in r.markdown[:12] and "var a" not in r.markdown[:40] for r in rows)


#: What holds for the queries that no SQL can express.
CHECKS = {
    "split_code": _pieces, "split_fences": _pieces, "chunk_prose": _chunked("".join), "chunk_code": _chunked("".join), "chunk_paragraphs": _chunked("\n\n".join), "chunk_overlapping": _chunked(None, whole=False), "clean_sanitize": _cleaned,
    "uuid_app_ids": _app_ids, "near_dup_suppressed": _kept, "elastic_windows": _windows, "topology_molecules": _molecules, "executed_search": _executed, "whole_search": _packed, "flexible_timestamps": _times, "record_normaliser": _records,
    "stream_sessions": _sessions, "p4_status": _status, "p4_ambiguous": _unsure, "html_markdown": _markdown,
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_holds(spark, sf, con, name):
    CHECKS[name](QUERIES[name](spark, sf).collect(), con)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
