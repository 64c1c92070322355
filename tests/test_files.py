from __future__ import annotations

import os
from datetime import datetime

import pytest

from palimpsest.functions import kernels as K
from palimpsest.functions import query as Q
from palimpsest.operators import links, mirror, packing
from palimpsest.operators import organize as O
from palimpsest.sources import files as S


def test_mirror_as_files(spark, tmp_path):
    rows = [(1, "# One\nbody", "a/x.md", ["b"], ["#t"], "internal", 0, datetime(2025, 1, 1)), (2, "two", "a/x.md", ["b"], ["#t"], None, 1, None), (3, "three", None, None, None, "internal", 0, None)]
    m = spark.createDataFrame(rows, "id bigint, content string, source string, buckets array<string>, tags array<string>, provenance string, sequence int, ts timestamp")
    docs = mirror.documents(mirror.bundles(m))
    want = {(r.dir, r.file): r.markdown for r in docs.collect()}
    got = {(r.dir, r.file): r.bytes for r in mirror.write_files(docs, str(tmp_path)).collect()}
    assert len(got) == 2 and set(got) == set(want)
    for (d, f), n in got.items():
        path = tmp_path / d / f
        assert path.read_text() == want[d, f] and os.path.getsize(path) == n and f.endswith(".md")
    assert sum(len(fs) for _, _, fs in os.walk(tmp_path)) == 2  # nothing half-written is left


def test_hydration(spark, tmp_path):
    schema = "id string, content string, n int"
    empty, full = spark.createDataFrame([], schema), spark.createDataFrame([("a", "b", 1)], schema)
    assert S.hydrated(empty, str(tmp_path)).collect() == []
    for name, text, at in (("old", "- id: 1\n  content: old\n", 1), ("new", "- id: 2\n  content: new\n  n: 7\n- id: 3\n  content: more\n- content:\n", 2)):
        (tmp_path / f"{name}.yaml").write_text(text)
        os.utime(tmp_path / f"{name}.yaml", (at, at))
    assert sorted(tuple(r) for r in S.hydrated(empty, str(tmp_path)).collect()) == [("2", "new", 7), ("3", "more", None)]
    assert [tuple(r) for r in S.hydrated(full, str(tmp_path)).collect()] == [("a", "b", 1)]


def test_wide_watcher_and_notes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y")
    (tmp_path / "b.log").write_text("z" * 100)
    (tmp_path / "c.bin").write_text("no")
    assert {os.path.basename(r.path) for r in S.read_wide(spark, str(tmp_path)).collect()} == {"a.csv", "b.log"}
    pages = spark.createDataFrame([("u", "<title>T</title><meta name=description content=D><p>x</p>"), (None, None)], "url string, html string")
    notes = {r.url: r.note for r in S.research_notes(pages, "c").collect()}
    assert notes["u"] == "---\ntitle: T\nurl: u\ncategory: c\ndescription: D\n---\n\nx" and notes[None].startswith("---\ntitle: \nurl: \n")


def test_weave_waits_for_idle_users(spark):
    s = spark.createDataFrame([(1, [1.0, 0.0], "a", datetime(2025, 1, 2))], "id bigint, embedding array<double>, app string, ts timestamp")
    o = spark.createDataFrame([(5, [1.0, 0.0], "a", datetime(2025, 1, 1, 20)), (6, [0.0, 1.0], "a", datetime(2025, 1, 1, 23))], "id bigint, embedding array<double>, app string, ts timestamp")
    assert [(r.o_id, r.method) for r in links.weave(s, o, "r").collect()] == [(5, "vector")]
    assert [(r.o_id, r.method) for r in links.weave(s, o, "r", threshold=2.0).collect()] == [(6, "timestamp")]
    assert links.weave(s, o, "r", idle_s=299).collect() == [] and links.weave(s, o, "r", idle_s=300).count() == 1


def test_snippets_in_order_of_score(spark):
    docs = spark.createDataFrame([(1, "x " * 300 + "needle one" + " y" * 300, "a", 1.0), (2, "needle two", "b", 9.0), (3, "none", "c", 5.0)], "id bigint, content string, source string, score double")
    w = packing.elastic_windows(docs, ["needle"], 1000)
    got = [(r.id, r.entry) for r in packing.snippet_context(w, docs, 10_000).orderBy("position").collect()]
    assert [i for i, _ in got] == [2, 2, 1, 1] and got[0][1] == "### Source: b (Score: 9)\n" and got[1][1] == "...needle two...\n\n"
    assert packing.snippet_context(w, docs, 45).count() == 2 and packing.snippet_context(w, docs, 5).count() == 0


@pytest.mark.parametrize(("text", "want"), [(r"a\\\\nb", "a\nb"), (r"a\nb", "a\nb"), ("plain", "plain"), ("\u2502 kept", "\u2502 kept")])
def test_peel(text, want):
    assert K.peel(text) == want


def test_legacy_k():
    assert [Q.legacy_k(n, d) for n, d in ((0, False), (20_000, False), (20_001, True), (200_000, True))] == [30, 40, 200, 400]


def test_back_fills_leave_what_is_there(spark):
    df = spark.createDataFrame([(1, "a", "kept"), (2, "b", " "), (3, None, None)], "id bigint, content string, app_id string")
    got = {r.id: r.app_id for r in O.backfill_app_ids(df).collect()}
    assert got[1] == "kept" and len(got[2]) == 36 and len(got[3]) == 36 and got[2] != got[3]


def test_keyset_pages_of_nothing(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "id bigint")
    assert [sorted(r.id for r in p.collect()) for p in O.keyset_pages(df, "id", 3)] == [[0, 1, 2], [3, 4, 5], [6]]
    assert list(O.keyset_pages(df.where("id > 10"), "id", 3)) == []
